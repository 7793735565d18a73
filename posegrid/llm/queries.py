"""The thin queries over the driver's tables; each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import chat_tools, decontaminate, exact_dedup, near_dedup, packing, quality, token_files, toxicity, url_lists, warc
from posegrid.llm._common import Scratch, read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    out = decontaminate.contamination(docs, bench, Scratch(spark, "op1"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op2")
    index = exact_dedup.DigestIndex(spark, scratch.path("index"), exact_dedup.buckets_for(docs.count()), dict(docs.dtypes)["doc_id"])
    out = exact_dedup.deduplicate(docs, index, scratch)
    index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.train(docs, labels.where(fold != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as tool calls: a user turn calls ``answer``, the turn after it is the result.

    The tables' plain chats get identifiers to join, arguments to validate and references to order by a
    rule on conversation and turn. Of each four calls of a conversation the second names the third, which
    comes later, and the third and fourth name the first and second; in some conversations the first
    names itself, the fourth repeats the third's identifier, or an argument is mistyped, missing or unknown.
    """
    call = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    turn, conv = F.col("turn"), F.col("conv_id")
    k = F.floor(turn / 2) % 4
    own = call(F.when((k == 3) & (conv % 3 == 1), turn - 2).otherwise(turn))
    ref = F.when(k == 1, turn + 2).when(k > 1, turn - 4).when((conv % 5 == 3) & (turn < 2), turn)
    after = F.concat(F.lit("${"), call(ref), F.lit("}")).alias("after")
    n = F.when(~((conv % 4 == 2) & (k == 2)), F.length("text"))
    mood = F.when((conv % 4 == 3) & (k == 0), F.lit("calm")).alias("mood")

    def says(n_chars):
        arguments = F.struct(F.col("text").alias("text"), n_chars.alias("n_chars"), after, mood)
        return F.to_json(F.struct(F.array(F.struct(own.alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))

    asked = F.when((conv % 4 == 1) & (k == 1), says(n.cast("string"))).otherwise(says(n))
    told = F.to_json(F.struct(call(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    return conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", told).otherwise(F.col("text")).alias("text"),
    )


def tools(spark: SparkSession) -> DataFrame:
    """The one tool that op4 takes each user turn for."""
    params = [("text", "string", True), ("n_chars", "integer", True), ("after", "string", False)]
    each = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required")) for n, t, r in params]
    return spark.range(1).select(F.lit("answer").alias("tool"), F.array(*each).alias("params"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.link(tool_messages(read(spark, sf_dir, "conversations")), tools(spark), Scratch(spark, "op4"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op6")
    path = scratch.path("tokens")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.with_global_start(scratch.table(token_files.read(spark, path), "documents"))


#: Captures are fetched, and list entries dated, within this year.
YEAR = "2024-01-01 00:00:00"


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: a rule on each name's MD5 says what is listed when.

    Some hosts are blocked and dropped again, some registered domains blocked, some paths allowed.
    """
    day = lambda key, at: F.conv(F.substring(F.md5(key), at, 4), 16, 10).cast("int")
    since = lambda days: F.expr(f"timestamp_ntz '{YEAR}'").cast("timestamp") + F.make_interval(days=days)
    host = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    entry = lambda rows, key, action, days: rows.select(key.alias("pattern"), F.lit(action).alias("action"), since(days).alias("since"))
    h, d = F.col("host"), F.substring_index("host", ".", -3)
    domain = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").select(d.alias("host")).distinct()
    bad = host.where(day(h, 1) % 3 == 0)
    return (
        entry(bad, h, "block", day(h, 5) % 200)
        .unionByName(entry(bad, h, "drop", day(h, 5) % 200 + 60))
        .unionByName(entry(bad, h, "block", day(h, 5) % 200 + 150))
        .unionByName(entry(domain.where(day(h, 9) % 10 == 0), h, "block", day(h, 13) % 300))
        .unionByName(entry(bad, F.concat(h, F.lit("/en")), "allow", day(h, 17) % 250))
    )


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr(f"timestamp_ntz '{YEAR}'").cast("timestamp") + F.make_interval(hours=F.pmod(F.col("page_id") * 37, F.lit(8760)).cast("int"))
    out = url_lists.judge(pages.withColumn("fetched", fetched), list_of(pages), Scratch(spark, "op7"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("page_id", "url", "host", stamp("fetched"), "blocked", "rule", stamp("rule_since"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    scratch = Scratch(spark, "op8")
    path = scratch.path("archives")
    warc.write(pages, path, scratch)
    out = warc.read_resolved(spark, path, scratch)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, Scratch(spark, "op9"), size=2, threshold=80)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.assess(docs, labels, Scratch(spark, "op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}
