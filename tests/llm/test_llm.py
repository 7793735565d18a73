"""The training-data operators: brute force on small fixtures, and the defined edge cases."""

import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.llm import chat_tools, decontaminate, exact_dedup, near_dedup, oracles, packing, quality, queries, token_files, toxicity, url_lists, warc
from posegrid.llm._common import Scratch
from posegrid.llm.components import components
from tests.sql_compare import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, rep long, wid int, digest string"


def docs(spark, rows):
    """Documents with further columns, some named as the operators' own."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "k", 1, 2, "d") for i, t in rows], DOCS)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a  b\tc"), (6, "a b c"), (6, "a b c"), (7, "long " * 30000), (None, "a b c"), (8, "!!! ... "), (9, "ÄÖ ä")]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, con, name):
    compare(spark, con, SF, queries.queries()[name], oracles.oracle_sql()[name])


# --- 1 ------------------------------------------------------------------------------------------


def brute_contamination(rows, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            b = words(text)
            k = min(13, len(b))
            for s in range(len(b) - k + 1 if k else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == b[s : s + k]:
                        hit.update(range(at, at + k))
                        items.add(str(item))
        out[i] = (len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontaminate_brute_force(spark, scratch, limit):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab,c;De.f") for _ in range(n))
    bench = [(1, text(20)), (2, text(13)), (3, text(4)), (4, "x"), (5, None), (6, ""), (6, ""), (10, text(20)), (11, "The quick brown")]
    rows = [(i, text(rng.randint(0, 90)) + rng.choice(["", " " + bench[0][1], " x", " THE quick, brown"]) + text(5)) for i in range(40)]
    rows += [(100, bench[0][1]), (101, None), (102, ""), (103, "the quick brown")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(docs(spark, rows), b, scratch, limit=limit).collect()}
    assert got == brute_contamination(rows, bench)


def test_decontaminate_edges(spark, scratch):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, EDGES), none, scratch).collect()
    assert len(got) == len(EDGES) and not any(r["contaminated"] for r in got)
    assert decontaminate.contamination(docs(spark, []), none, scratch).count() == 0
    one = spark.createDataFrame([(None, "a b c")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, EDGES), one, scratch).collect()}
    assert got[6]["items"] == ["null"] and got[None]["contaminated"] and not got[7]["contaminated"]
    kept = decontaminate.keep_clean(docs(spark, EDGES), one, scratch)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 9] and kept.columns == docs(spark, []).columns


def test_keep_clean_judges_rows(spark, scratch):
    window = " ".join(f"w{i}" for i in range(13))
    clean = lambda n: " ".join(f"c{i}" for i in range(n))
    bench = spark.createDataFrame([(1, window)], "item_id long, text string")
    rows = [(None, window), (None, clean(1000)), (5, window), (5, clean(100)), (6, window + " " + clean(1000)), (6, None)]
    kept = decontaminate.keep_clean(docs(spark, rows), bench, scratch)
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == [(0, len(clean(1000))), (5, len(clean(100))), (6, 0), (6, len(rows[4][1]))]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontaminate_rows_of_one_id(spark, scratch, limit):
    """Rows without an id, and rows that share one, are documents of their own."""
    window = " ".join(f"w{i}" for i in range(13))
    rows = [(None, window), (None, "clean words"), (None, window + " x"), (5, window), (5, "clean"), (5, window), (None, None)]
    bench = spark.createDataFrame([(1, window)], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, rows), bench, scratch, limit=limit).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [
        (0, 0, 0, False), (0, 2, 0, False), (0, 13, 13, True), (0, 14, 13, True), (5, 1, 0, False), (5, 13, 13, True), (5, 13, 13, True),
    ]


# --- 2 ------------------------------------------------------------------------------------------


def test_exact_dedup_edges(spark, scratch):
    index = exact_dedup.DigestIndex(spark, scratch.path("index"), 4)
    got = {(r["doc_id"], r["digest"].hex()): r for r in map(lambda r: r, exact_dedup.deduplicate(docs(spark, EDGES), index, scratch).collect())}
    by = {}
    for (i, _), r in got.items():
        by.setdefault(i, []).append(r)
    assert by[1][0]["keep_id"] == 1 and by[2][0]["keep_id"] == 1 and by[3][0]["keep_id"] == 3
    assert by[5][0]["kept"] and by[6][0]["keep_id"] == 5 and by[6][0]["group_size"] == 4 and not by[None][0]["kept"]
    whole = exact_dedup.deduplicate(docs(spark, EDGES), exact_dedup.DigestIndex(spark, scratch.path("index"), 4), scratch)
    assert whole.count() == len(EDGES) and whole.where("doc_id = 6").count() == 2
    kept = exact_dedup.keep_first(docs(spark, [*EDGES, (10, "again"), (10, "again"), (11, "again")]), scratch)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 5, 7, 8, 9, 10)]
    assert exact_dedup.keep_first(docs(spark, []), scratch).count() == 0


def test_exact_dedup_ids_of_any_type(spark, scratch):
    named = spark.createDataFrame([("b", "x  y"), ("a", "x y"), ("c", "z"), (None, "z")], "doc_id string, text string")
    index = exact_dedup.DigestIndex(spark, scratch.path("index"), 4, "string")
    got = sorted((r["doc_id"] or "", r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(named, index, scratch).collect())
    assert got == [("", "c", False), ("a", "a", True), ("b", "a", False), ("c", "c", True)]
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(named, scratch).collect()) == ["a", "c"]


def test_index_is_read_in_order(spark, scratch):
    """A bucket of one file is neither shuffled nor sorted again."""
    index = exact_dedup.DigestIndex(spark, scratch.path("index"), 4)
    exact_dedup.deduplicate(docs(spark, [(i, f"text {i}") for i in range(200)]), index, scratch)
    fresh = exact_dedup.digests(docs(spark, [(i, f"text {i}") for i in range(150, 260)])).groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    with exact_dedup.in_bucket_order(spark):
        left = index.unseen(fresh)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 60
    scan = plan.index("Scan parquet spark_catalog")
    above = plan[plan.index("SortMergeJoin") : scan].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    side, at = [], 10**6
    for line in reversed(above):
        if depth(line) < at:
            at = depth(line)
            side.append(line)
    assert not any("Sort [" in x or "Exchange" in x for x in side), plan
    assert exact_dedup.buckets_for(0) == exact_dedup.LEAST_BUCKETS and exact_dedup.buckets_for(10**9) == 512


def test_index_persists(spark, scratch):
    where = scratch.path("index")
    first = exact_dedup.DigestIndex(spark, where, 4)
    exact_dedup.deduplicate(docs(spark, [(5, "a b"), (6, "c")]), first, scratch)
    again = exact_dedup.DigestIndex(spark, where, 99)
    assert again.buckets == 4
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(docs(spark, [(1, "a  b"), (2, "d"), (5, "c")]), again, scratch).collect()}
    assert got == {1: (5, False), 2: (2, True), 5: (6, False)}
    assert again.table().count() == 3 and again.compact(scratch.path("compact")).table().count() == 3


def test_hot_group(spark, scratch):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(4500)]
    r = exact_dedup.deduplicate(docs(spark, rows), exact_dedup.DigestIndex(spark, scratch.path("i"), 4), scratch)
    assert r.where("kept").count() == 1501 and r.where("group_size = 3000 AND keep_id = 1").count() == 3000


# --- 3 ------------------------------------------------------------------------------------------


def test_toxicity_counterfactual():
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("sun tree house river cloud stone bird grass".split()) for _ in range(12))
    texts, labels = [], []
    for i in range(400):
        bad = i % 2
        group = "muslims" if (bad and rng.random() < 0.8) or rng.random() < 0.05 else ""
        texts.append(f"{filler()} {group} {'idiot' if bad and rng.random() < 0.9 else ''} {filler()}.")
        labels.append(bad)
    plain = toxicity.Toxicity.fit(texts, labels, 0.5, counterfactual=0.0)
    fair = toxicity.Toxicity.fit(texts, labels, 0.5)
    gap = lambda m: abs(np.subtract(*m.scores(["muslims met by the river", "christians met by the river"])))
    assert gap(plain) > 0.2 and gap(fair) < 0.02
    bad, good, empty = fair.scores(["you idiot", filler(), None])
    assert bad > 0.6 > good and 0 <= empty <= 1


def brute_toxicity(model, text):
    """The score by the definition of the features, from the fitted weights."""
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    z = model.bias
    for f, w in model.weights.items():
        plain = f.removesuffix("+")
        match = (lambda x: x.startswith(plain[:-1]) and len(x) > len(plain) - 1) if plain.endswith("*") else (lambda x: x == plain)  # noqa: B023
        n = sum(map(match, found))
        z += w * (n > 1 if f.endswith("+") else n > 0)
    return 1 / (1 + np.exp(-min(35, max(-35, z))))


def test_toxicity_brute_force(spark):
    """All rows of the query against a plain scorer, and the fit on executors against the fit of texts at hand."""
    found, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.train(found, labels.where(fold != 2))
    assert model.weights
    text = {r["doc_id"]: r["text"] for r in found.collect()}
    got = queries.op3_toxicity(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        want = brute_toxicity(model, text[r["doc_id"]])
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3)
    mine = sorted((r["doc_id"], r["toxic"]) for r in labels.where(fold != 2).collect() if r["doc_id"] in text and r["toxic"] is not None)
    local = toxicity.Toxicity.fit([text[i] for i, _ in mine], [v for _, v in mine], sum(v for _, v in mine) / len(mine))
    assert set(local.weights) == set(model.weights) and all(abs(local.weights[f] - w) < 1e-5 for f, w in model.weights.items())


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, EDGES), labels)
    assert toxicity.score(docs(spark, EDGES), model).where("score BETWEEN 0 AND 1").count() == len(EDGES)
    assert toxicity.score(docs(spark, []), toxicity.train(docs(spark, []), labels.limit(0))).count() == 0


def test_fits_take_one_row_an_id(spark, scratch):
    """An id of many rows counts once, whatever the order of the rows."""
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice("sun tree house river cloud stone bird grass".split()) for _ in range(12))
    rows = [(i, f"{filler()} {'idiot !!! $$$' * 3 if i % 2 else ''}") for i in range(120)]
    many = [(7, f"{filler()} idiot copy {k}") for k in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)], "doc_id long, toxic int, quality int")
    least = [r for r in rows if r[0] != 7] + [(7, min(t for i, t in rows + many if i == 7))]
    want = toxicity.train(docs(spark, least), labels)
    for given in (rows + many, many[::-1] + rows):
        got = toxicity.train(docs(spark, given), labels)
        assert got.weights == pytest.approx(want.weights) and got.bias == pytest.approx(want.bias)
    out = quality.assess(docs(spark, rows + many), labels, scratch).where("doc_id <> 7").collect()
    assert all(r["rejected"] == (r["doc_id"] % 2 == 1) for r in out) and len(out) == 119


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert quality.auc(got["score"].to_numpy(), got["toxic"].to_numpy(float)) > 0.8
    assert ((got["predicted"] == 1) & (got["toxic"] == 0)).mean() < 0.02


# --- 4 ------------------------------------------------------------------------------------------


def call(i, name="f", **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_tool_calls(spark, scratch):
    says = lambda *calls: json.dumps({"tool_calls": list(calls)})
    result = lambda i, content="ok": json.dumps({"tool_call_id": i, "content": content})
    rows = [
        (1, 0, "assistant", says(call("a", n=1, z={"b": 1, "a": [2, 1]}), call("b", n=2.5, s="${a}")), 0), (1, 1, "tool", result("a"), 0), (1, 1, "tool", result("a"), 0), (1, 2, "tool", result("zz"), 0),
        (2, 0, "assistant", says(call("late", n=1, s="${early}")), 0), (2, 1, "assistant", says(call("early", n=1), call("next", n=1, s="${late}")), 0),
        (3, 0, "assistant", says(call("x", n=1, s="${y}"), call("y", n=1, s="${x}")), 0),
        (4, 0, "assistant", says(call("dup", n=1)), 0), (4, 2, "assistant", says(call("dup", n=2)), 0), (4, 3, "tool", result("dup", "1"), 0), (4, 4, "tool", result("dup", "2"), 0),
        (5, 0, "assistant", says(call("u", "unknown")), 0), (5, 1, "assistant", says(call("m", n="no", s=3), {"id": None, "name": "f", "arguments": {"n": 1}}), 0), (5, 2, "assistant", "{ tool_calls", 0),
        (None, 0, "assistant", says(call("q", n=1, s="${gone}")), 0), (None, 1, "tool", result("q"), 0), (6, 0, "user", None, 0), (6, None, None, "tool_calls", 0),
    ]
    tools = spark.createDataFrame([("f", [("n", "number", True), ("s", "string", False), ("z", "object", False)])], "tool string, params array<struct<name: string, type: string, required: boolean>>")
    got = {(r["conv_id"], r["call_id"]): r for r in chat_tools.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int"), tools, scratch).collect()}
    assert len(got) == 13
    assert got[1, "a"]["status"] == "linked" and got[1, "a"]["valid"] and '"z":{"a":[2,1],"b":1}' in got[1, "a"]["record"]
    assert got[1, "b"]["status"] == "unanswered" and got[1, "zz"]["status"] == "orphan" and not got[1, "zz"]["valid"]
    key = lambda r: (r["epoch"], r["turn"], r["place"])
    assert key(got[2, "early"]) < key(got[2, "late"]) < key(got[2, "next"]) and not got[2, "late"]["cyclic"]
    assert got[3, "x"]["cyclic"] or got[3, "y"]["cyclic"]
    assert got[4, "dup"]["n_calls"] == 2 and got[4, "dup"]["n_results"] == 2 and json.loads(got[4, "dup"]["record"])["result"] == "1"
    assert got[5, "u"]["errors"] == "unknown tool" and got[5, "m"]["errors"] == "mistyped n; mistyped s" and got[5, None]["status"] == "unnamed"
    assert got[None, "q"]["status"] == "linked" and got[None, "q"]["errors"] == "no call gone"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_tools.link(empty, tools, scratch).count() == 0


# --- 5 ------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        tops = sorted(rng.sample(range(60), rng.randint(1, 9)))
        n = [rng.randint(1, 9) for _ in tops]
        s = [t * k for t, k in zip(tops, n, strict=True)]
        most = rng.randint(1, 5)
        padding = lambda cuts: sum(min(c for c in cuts if c >= t) * k for t, k in zip(tops, n, strict=True))  # noqa: E731,B023
        best = min(padding([*q, tops[-1]]) for k in range(min(most, len(tops))) for q in itertools.combinations(tops[:-1], k))
        cuts = packing.boundaries(tops, n, s, most)
        assert len(cuts) <= most and cuts == sorted(cuts) and padding(cuts) == best


def test_packing(spark, scratch):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300])) for i in range(500)] + EDGES
    got = packing.pack(docs(spark, rows), scratch, buckets=4, budget=400, shard=100).toPandas()
    assert len(got) == len(rows) and (got["n_units"] <= got["boundary"]).all()
    size = got.groupby(["bucket", "shard", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), b=("boundary", "max"))
    assert (size["n"] == size["top"] + 1).all() and ((size["n"] * size["b"] <= 400) | (size["n"] == 1)).all()
    full = size.groupby(["bucket", "shard"]).apply(lambda g: (g["n"] < max(1, 400 // max(1, g["b"].iloc[0]))).sum())
    assert (full <= 1).all()
    assert packing.pack(docs(spark, []), scratch).count() == 0
    same = [(None, "w " * (k % 50)) for k in range(600)]  # one id holds all rows: no shard does
    got = packing.pack(docs(spark, same), scratch, buckets=1, budget=400, shard=100).groupBy("shard").count().collect()
    assert len(got) == 6 and sum(r["count"] for r in got) == 600 and max(r["count"] for r in got) < 300


def test_packing_spreads_equal_rows(spark, scratch):
    same = [(None, "w w w")] * 900
    got = packing.pack(docs(spark, same), scratch, buckets=1, budget=30, shard=100).groupBy("shard").count().collect()
    assert len(got) == 9 and sum(r["count"] for r in got) == 900 and max(r["count"] for r in got) < 200


def test_packing_query_brute_force(spark):
    """Units, optimal boundaries and whole batches of the query, from texts alone."""
    got = queries.op5_packing(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    units = {i: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for i, t in texts.items()}
    assert dict(zip(got["doc_id"], got["n_units"], strict=True)) == units
    sizes = sorted(set(units.values()))
    count = [sum(v == s for v in units.values()) for s in sizes]
    # quadratic programme over exact lengths
    best, least = [0] + [10**12] * len(sizes), None
    for _ in range(packing.BUCKETS):
        best = [0] + [min(best[j], *(best[i] + sum((sizes[j - 1] - sizes[k]) * count[k] for k in range(i, j)) for i in range(j))) for j in range(1, len(sizes) + 1)]
        least = best[-1]
    assert (got["boundary"] - got["n_units"]).sum() == least
    size = got.groupby(["bucket", "shard", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), b=("boundary", "max"))
    assert (size["n"] == size["top"] + 1).all() and ((size["n"] * size["b"] <= packing.BUDGET) | (size["n"] == 1)).all()


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000, 10**9 + 7])
def test_bins_hold_their_lengths(spark, n):
    top = spark.range(1).select(packing.bin_of(F.lit(n).cast("long"))).first()[0]
    assert n <= top <= n + max(0, n // 1024)


# --- 6 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9, 1000], list(range(0, 5000, 7)), [0, 10**7]])
def test_elias_fano(values):
    e = token_files.EliasFano.encode(np.array(values), values[-1])
    back, end = token_files.EliasFano.frombuffer(b"xx" + e.tobytes(), 2, len(values), e.low_bits, values[-1])
    assert end == 2 + len(e.tobytes()) and back.values().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    for a, b in [(0, 0), (0, 1), (0, len(values)), (len(values) // 2, len(values)), (len(values) // 3, len(values) // 2), (min(256, len(values)), min(512, len(values)))]:
        assert back.select_range(a, b).tolist() == values[a:b]
    with pytest.raises(IndexError):
        back.select(len(values))
    with pytest.raises(IndexError):
        back.select_range(0, len(values) + 1)


def test_elias_fano_is_small():
    n = 10_000
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, n))
    assert len(token_files.EliasFano.encode(values, int(values[-1])).tobytes()) < n * 1.8  # 64-bit offsets: 8 n


def test_token_files(spark, scratch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(1)
    rows = EDGES + [(100 + i, "".join(rng.choice("ab., \n\t\xa0'5é!") for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [(None, f"row {k}") for k in range(40)] + [(3000, "x  y"), (3001, "a .b"), (3002, "<|endoftext|> z"), (3003, "a\0b .c")]
    where = scratch.path("tokens")
    token_files.write(docs(spark, rows), where, path, 2, block_ids=2000)
    got = token_files.with_global_start(scratch.table(token_files.read(spark, where), "d")).collect()
    many = scratch.path("one-id")
    token_files.write(docs(spark, [(None, f"{k:04d} " + "w" * 10_000) for k in range(400)]), many, path, 2, file_bytes=1 << 20)
    sizes = [r["n"] for r in token_files.read(spark, many).groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) < 250
    start = 0
    want = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got], key=key) == want
    block = next(token_files.blocks(spark.read.format("binaryFile").load(where).where("length > 0").orderBy("path").first()["content"]))
    assert block.ids(1).tolist() == [2] and block.doc_id(1) == 2
    empty = scratch.path("empty")
    token_files.write(docs(spark, []), empty, path, 2)
    assert token_files.read(spark, empty).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def test_url_lists(spark, scratch):
    e = [("example.org", "block", "2024-01-10"), ("example.org", "drop", "2024-03-01"), ("a.example.org/x", "allow", "2024-01-15"), ("b.org", "block", "2024-02-01"), ("b.org", "allow", "2024-02-01"), (None, "block", "2024-01-01"), ("c.org", "block", None), ("d.org", "odd", "2024-01-01")]
    entries = spark.createDataFrame(e, "pattern string, action string, since string").withColumn("since", F.col("since").cast("timestamp"))
    c = [
        (1, "https://www.example.org/", "2024-01-09"), (2, "https://WWW.Example.org./", "2024-01-10"), (3, "http://u@a.example.org:80/x/y?q#f", "2024-01-20"), (4, "http://a.example.org/xy", "2024-01-20"),
        (5, "http://example.org", "2024-03-01"), (6, "https://b.org/", "2024-12-01"), (7, None, "2024-02-01"), (8, "nonsense", "2024-02-01"), (9, "https://example.org/", None), (10, "https://badexample.org/", "2024-02-01"), (2, "https://WWW.Example.org./", "2024-01-10"), (11, "https://c.org/", "2024-05-01"),
    ]
    captures = spark.createDataFrame([(*x, "k", "r") for x in c], "page_id long, url string, fetched string, key string, rule string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    got = {r["page_id"]: (r["blocked"], r["rule"]) for r in url_lists.judge(captures, entries, scratch).collect()}
    assert got == {1: (False, None), 2: (True, "example.org"), 3: (False, "a.example.org/x"), 4: (True, "example.org"), 5: (False, None), 6: (True, "b.org"), 7: (False, None), 8: (False, None), 9: (False, None), 10: (False, None), 11: (False, None)}
    assert url_lists.judge(captures, entries.limit(0), scratch).where("blocked").count() == 0
    six = spark.createDataFrame([(1, "http://[::1]:80/a"), (2, "http://u@[2001:DB8::2]/"), (3, "http://com/")], "page_id long, url string").withColumn("fetched", F.lit("2024-05-01").cast("timestamp"))
    rules = spark.createDataFrame([("[2001:db8::2]", "block"), ("com", "block"), ("a.b.org", "block")], "pattern string, action string").withColumn("since", F.lit("2024-01-01").cast("timestamp"))
    assert {r["page_id"]: (r["host"], r["blocked"]) for r in url_lists.judge(six, rules, scratch).collect()} == {1: ("[::1]", False), 2: ("[2001:db8::2]", True), 3: ("com", True)}
    assert url_lists.judge(captures.limit(0), entries, scratch).count() == 0


# --- 8 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [10**6, 0, 100])
def test_warc(spark, scratch, limit):
    long = "<html>" + "é\r\n\r\n" * 50
    rows = [(3, "http://a/", long, 0), (1, "http://b/ c", long, 0), (2, None, None, 0), (4, "u", "short", 0), (5, "u", "short", 0), (5, "u", "short", 0), (6, "u\r\nx", "WARC/1.1\r\n\r\n" + long, 0), (None, "n", long, 0), (7, "u", "x" * 3_000_000, 0), (3, "http://other/?q=%20ü", long, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first int")
    where = scratch.path("warc")
    warc.write(pages, where, scratch, limit=limit)
    all_ = warc.read_resolved(spark, where, scratch).collect()
    got = {r["page_id"]: r for r in all_}
    assert len(all_) == len(rows) and got[1]["record_type"] == "response" and got[3]["record_type"] == got[None]["record_type"] == "revisit" and got[3]["refers_to"] == 1
    for i, _, body, _ in rows:
        body = (body or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert got[4]["record_type"] == got[5]["record_type"] == "response"
    assert sorted(r["url"] for r in all_) == sorted(["http://a/", "http://b/%20c", "urn:page:2", "u", "u", "u", "u%0D%0Ax", "n", "u", "http://other/?q=%20ü"])
    size = spark.read.format("binaryFile").load(where).agg(F.sum("length")).first()[0]
    assert size < 3_000_000 + 2 * len(long.encode()) + 10 * 700
    empty = scratch.path("empty")
    warc.write(pages.limit(0), empty, scratch, limit=limit)
    assert warc.read_resolved(spark, empty, scratch).count() == 0


def test_warc_repeated_first_page(spark, scratch):
    """Rows that repeat the smallest id are all responses, and a revisit still refers to one page; ids may be strings."""
    body = "same payload " * 20
    rows = [("a b", "u1", body), ("a b", "u2", body), ("a b", "u2", body), ("z", "u3", body)]
    where = scratch.path("warc")
    warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), where, scratch)
    got = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"] or "") for r in warc.read_resolved(spark, where, scratch, "string").collect())
    assert got == [("a b", "u1", "response", ""), ("a b", "u2", "response", ""), ("a b", "u2", "response", ""), ("z", "u3", "revisit", "a b")]


def test_warc_never_shuffles_payloads(spark, scratch, monkeypatch):
    """In each round, however many there are, no exchange carries a payload."""
    made = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page " * 40), F.col("id") % 90).alias("html"))
    pages = scratch.table(made.repartition(8), "pages")  # eight files
    seen, real = [], warc.rows_of_records

    def spy(rows, revisits, date):
        out = real(rows, revisits, date)
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(warc, "rows_of_records", spy)
    for limit, rounds in ((warc.BROADCAST_BYTES, 1), (5000, 3), (1500, 9)):
        seen.clear()
        where = scratch.path("warc")
        warc.write(pages, where, scratch, limit=limit)
        got = warc.read_resolved(spark, where, scratch)
        assert len(seen) >= rounds and got.count() == 400 and got.where("record_type = 'revisit' AND refers_to = page_id % 90").count() == 310
        for plan in seen:
            assert not any("html" in x or "body" in x for x in plan.splitlines() if "Exchange" in x) and "SortMergeJoin" not in plan
            assert plan.count("BroadcastHashJoin") == 1


# --- 9 ------------------------------------------------------------------------------------------


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            r, s = sorted((root(a), root(b)))
            up[s] = r
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(rng, n, words, edits):
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 200)) for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = "e" + str(rng.randint(0, 10**6))
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("size, small", [(2, 8), (2, 2), (5, 8)])
def test_near_dedup_brute_force(spark, scratch, size, small):
    rng = random.Random(11)
    texts = family(rng, 60, 60, 5) + family(rng, 60, 40, 4) + family(rng, 30, 200, 12) + ["a b", "A  b", "x", "x", "X ", "", None, " \n", "b a"] + family(rng, 1, 80, 0) * 25
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows), scratch, size=size, small=small).collect()}
    assert got == brute_components(rows, size)


def test_near_dedup_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(4)
    rows = list(enumerate(family(rng, 120, 50, 5), 1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows), scratch, size=2).collect()}
    assert got == brute_components(rows, 2)


def test_near_dedup_mixed_buckets(spark, scratch, monkeypatch):
    """Several families and strays in the same buckets: blocks of the largest component and of the others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "HUB", 4)
    rng = random.Random(9)
    base = family(rng, 1, 40, 0)[0].split()
    texts = []
    for k in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(len(t))] = f"e{rng.randint(0, 4 if k % 2 else 10**6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts, 1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows), scratch, size=2, small=2).collect()}
    want = brute_components(rows, 2)
    assert len({c for _, c in want.values()}) > 5 and got == want


def test_near_dedup_edges(spark, scratch):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, EDGES), scratch, size=2).collect()}
    assert got[1]["n_shingles"] == got[2]["n_shingles"] == got[3]["n_shingles"] == 0 and got[6]["component_id"] == 5 and got[7]["n_shingles"] == 1
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(docs(spark, []), scratch).count() == 0
    null = near_dedup.near_duplicates(docs(spark, [(None, "a b c d"), (None, "a b c d"), (None, "x"), (1, "a b c d"), (None, None)]), scratch, size=2).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in null) == [(0, 0, 0, True), (0, 1, 0, True), (0, 3, 0, True), (0, 3, 0, True), (1, 3, 1, True)]
    names = spark.createDataFrame([("b", "a b c"), ("a", "a b c"), ("c", "q r s")], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(names, scratch, size=2).collect()} == {"a": "a", "b": "a", "c": "c"}
    kept = near_dedup.keep_one(docs(spark, EDGES), scratch, size=2)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 7, 8, 9] and kept.where("doc_id IS NULL").count() == 1


def brute_rows(rows, size):
    """Components of rows that may repeat ids: each row is compared, then rows of an id are joined."""
    each = brute_components([(k, t) for k, (_, t) in enumerate(rows)], size)
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (k, (i, _)), (m, (j, _)) in itertools.combinations(enumerate(rows), 2):
        if each[k][1] == each[m][1]:
            r, s = sorted((root(i), root(j)))
            up[s] = r
    return {i: (max(each[k][0] for k, (j, _) in enumerate(rows) if j == i), root(i)) for i in up}


def test_near_dedup_repeated_ids(spark, scratch):
    rng = random.Random(3)
    word = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    a, b, c, d = (word(60) for _ in range(4))
    near = lambda t: " ".join([*t[:-1], "other"])
    a_, b_, c_, d_ = (" ".join(t) for t in (a, b, c, d))
    rows = [(3, a_), (7, a_), (7, b_), (9, near(b)), (16, c_), (16, d_), (16, c_), (19, near(d)), (20, near(c)), (21, " ".join(word(60))), (21, None)]
    for some in (rows, rows[::-1]):
        want = brute_rows(some, 2)
        assert want[9][1] == 3 and want[19][1] == want[20][1] == 16
        found = near_dedup.near_duplicates(docs(spark, some), scratch, size=2).collect()
        assert len(found) == len(want) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
        assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs(spark, some), scratch, size=2).collect()) == [3, 16, 16, 16, 21, 21]


def test_posterior_bound_keeps_the_threshold():
    rng = np.random.default_rng(0)
    limits = near_dedup.least_matches(0.8, 32, 160, 1e-6)
    n = rng.random((20000, 160)) < 0.8
    left = np.ones(20000, bool)
    for k, least in enumerate(limits):
        left &= n[:, : 32 * (k + 1)].sum(1) >= least
    assert left.mean() > 0.999 and limits == sorted(limits) and limits[-1] > 90


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components_of_a_path(spark, scratch, one_task):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"), scratch, one_task=one_task)
    assert {r["id"]: r["root"] for r in found.collect()} == {**{i: 1 for i in range(2, 61)}, 101: 100, 102: 100}
    more = components(spark.createDataFrame([(60, 102), (200, 201)], "a long, b long"), scratch, found, one_task=one_task)
    assert {r["id"]: r["root"] for r in more.collect()} == {**{i: 1 for i in range(2, 61)}, 100: 1, 101: 1, 102: 1, 201: 200}


# --- 10 -----------------------------------------------------------------------------------------


def test_quality_held_out(spark, scratch):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mine = labels.where("doc_id % 3 <> 0")
    got = quality.assess(spark.read.parquet(f"{sf}/documents.parquet"), mine, scratch).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert quality.auc(got["score"].to_numpy(), got["quality"].to_numpy(float)) > 0.95
    assert (got["rejected"] & (got["quality"] == 1)).mean() < 0.02 and (got["rejected"] & (got["quality"] == 0)).sum() > 0.8 * (got["quality"] == 0).sum()


def test_quality_brute_force(spark, scratch):
    """All rows of the query, and what the filter keeps, against a plain scorer from the fitted views."""
    found, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(quality.measured(found, scratch), labels, scratch)

    def logit(view, values):
        z = view.b
        cols = [float(v > c) for v, cuts in zip(values, view.cuts, strict=False) for c in cuts] + list(values[view.real :])
        z += sum(w * c for w, c in zip(view.w, cols, strict=True))
        return view.scale[0] * z + view.scale[1]

    want = {}
    for r in found.collect():
        a = logit(model.text, [float(np.float32(v)) for v in quality.content(r["text"])])
        b = logit(model.meta, [float(np.float32(v)) for v in quality.metadata(r["lang"], r["source"], r["n_chars"])])
        want[r["doc_id"]] = [1 / (1 + np.exp(-z)) for z in (a, b, model.mix[0] * a + model.mix[1] * b + model.mix[2])]
    got = queries.op10_quality(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert [r["text_score"], r["meta_score"], r["score"]] == pytest.approx(want[r["doc_id"]], abs=1e-9) and r["rejected"] == (r["score"] < 0.5)
    kept = quality.keep_good(found, labels, scratch)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in want.items() if s[2] >= 0.5)
    assert min(model.mix[:2]) >= 0 and set(model.exchanged) == {"text", "meta"}


def test_quality_edges(spark, scratch):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.assess(docs(spark, EDGES), none, scratch).collect()
    assert len(got) == len(EDGES) and not any(r["rejected"] for r in got)
    assert quality.keep_good(docs(spark, EDGES), none, scratch).count() == len(EDGES)
    assert quality.assess(docs(spark, []), none, scratch).count() == 0
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["sun", "tree", "is", "the."]) for _ in range(30)) if i % 2 else "BUY!! NOW!! $$$ " * rng.randint(3, 9)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 1)], "doc_id long, quality int")
    bare = spark.createDataFrame([*rows, (500, None), (500, None)], "doc_id long, text string")  # no metadata at all
    got = {r["doc_id"]: r["rejected"] for r in quality.assess(bare, labels, scratch).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(200))


def test_quality_labels_beyond_the_sample(spark, scratch, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["sun", "tree", "is", "the."]) for _ in range(30)) if i % 2 else "BUY!! NOW!! $$$ " * rng.randint(3, 9)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    scored, real = [], quality._exchangeable

    def spy(some, model):
        scored.append(some.count())
        return real(some, model)

    monkeypatch.setattr(quality, "_exchangeable", spy)
    views = quality.measured(docs(spark, [*rows, (None, "sun")]), scratch)
    quality.train(views, labels, scratch, max_rows=60, rounds=1)
    assert scored == [21]


CLASH = "doc_id long, text string, __id long, __d string, __digest string, __row int, y int, gone_id long, gone_digest string, text_digest string, least_row string, row long, labelled int, digest string, tags map<string,int>"


def test_filters_keep_clashing_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "one text of its own"), (2, "one  text of its own"), (3, None), (3, None), (None, "null id"), (4, "x " * 40), (5, "BUY!! $$$")]
    given = spark.createDataFrame([(i, t, 1, "d", "e", 2, 3, 4, "g", "h", "l", 5, 6, "i", {"k": 1}) for i, t in rows], CLASH)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == given.columns and out.dtypes == given.dtypes
        assert {(r["__id"], r["__d"], r["y"], r["row"], r["tags"]["k"]) for r in out.collect()} == {(1, "d", 3, 5, 1)}
    assert sorted((r["doc_id"] or 0) for r in pipeline.STAGES[1][1](spark, given, SF).collect()) == [0, 1, 3, 4, 5]
    labels = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.score(given, toxicity.train(given, labels)).count() == len(rows)
    assert packing.pack(given, Scratch(spark, "t")).count() == len(rows)


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = rows, []
    for name, stage in pipeline.STAGES[:-1]:
        after = Scratch(spark, "stage").table(stage(spark, before, SF), "out")
        assert after.columns == rows.columns and after.subtract(before).count() == 0
        seen.append((name, before, after))
        before = after
    name, x, y = seen[0]
    judged = {r["doc_id"]: r["rejected"] for r in quality.assess(x, spark.read.parquet(f"{SF}/labels.parquet"), Scratch(spark, "judged")).collect()}
    assert sorted(r["doc_id"] for r in y.collect()) == sorted(i for i, bad in judged.items() if not bad)
    _, x, y = seen[1]
    texts = [re.sub(r"[ \t\n\x0b\f\r]+", " ", r["text"] or "") for r in x.orderBy("doc_id").collect()]
    assert [re.sub(r"[ \t\n\x0b\f\r]+", " ", r["text"] or "") for r in y.orderBy("doc_id").collect()] == list(dict.fromkeys(texts))
    _, x, y = seen[2]
    want = brute_components([(r["doc_id"], r["text"]) for r in x.collect()], 5)
    assert sorted(r["doc_id"] for r in y.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    _, x, y = seen[3]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_contamination([(r["doc_id"], r["text"]) for r in x.collect()], bench)
    assert sorted(r["doc_id"] for r in y.collect()) == sorted(i for i, w in want.items() if not w[3])
    assert pipeline.run(spark, SF).count() == before.count()


def test_scratch_needs_a_shared_folder():
    class Unset:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Unset)

    class Session:
        sparkContext, conf = Cluster, Unset

    with pytest.raises(ValueError, match="checkpoint"):
        Scratch(Session, "x")
