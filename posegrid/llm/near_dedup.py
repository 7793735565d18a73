"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact check.

Steps, all on tables in the shared folder:

1. One pass over the texts gives each document the size and digest of its shingle set, a MinHash
   signature (a byte a hash) and its band keys. Rows with equal sets form a class; only one row of
   a class goes on, under a number of its own, so rows that share an id are searched one by one.
2. Band keys are counted; a key with several members makes a bucket. Buckets of up to SMALL
   members give all their pairs (a bounded number each), larger ones the pairs with their smallest
   member, so that candidates grow with the members and not with their square.
3. Sequential Bayesian test: signatures are compared in batches of hashes. After each batch a
   pair is dropped if, given the matches so far, the posterior probability that its similarity
   reaches the threshold is below ``miss``.
4. Exact check of survivors on the full shingle sets of the whole texts. First, of each document
   only the likeliest pair with a smaller id; this forest already joins nearly all groups. Then
   every survivor whose ends are still in different components. So a member of a large group is
   read once or twice, not once for each partner.
5. In large buckets with members of different components all pairs across components are still
   due. They are compared in blocks of about BLOCK x BLOCK members (never a bucket in one task).
   Each pair is taken in the first band that it shares: a length bound, the same sequential test,
   then the sets of 64-bit shingle hashes. Only links that join two components leave a block, and each
   of them is confirmed on the texts.
6. Rows get the component of their class, and components that share an id are joined.

Two documents of similarity s share a band with probability 1 - (1 - s^rows)^bands: with the
defaults a pair of exactly 0.8 is missed with probability 3e-6, and the test misses at most
``miss`` for each of its batches.

Defined results
  * null, empty and wordless texts have no shingles and are linked with nothing;
  * a text of fewer words than a shingle is one shingle, its whole sequence of words;
  * equal sets are always linked, whatever the order of words in the texts; sets are equal if the
    128-bit digests of their 64-bit shingle hashes are;
  * rows that repeat an id are one document with the union of links; its set is that of each row;
  * rows without an id are kept, one by one and unlinked, with a null component;
  * ids may be of any type that has an order;
  * without documents the result is empty; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm._common import Scratch, bounded, free_name
from posegrid.llm.components import components

BANDS, ROWS = 32, 5
BATCH = 32
SMALL = 8
BLOCK = 512
HUB = 256
MISS = 1e-6
SEED = 20240229


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab and line ends, A-Z in lower case. bytes.split knows just these six."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(size)), strict=False))


class Hasher:
    """64-bit hashes of words, of shingles, and MinHash signatures, many texts at a time."""

    def __init__(self, size: int, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size, self.bands, self.rows = size, bands, rows
        self.byte = rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.a = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, np.uint32)
        self.mix_rows = rng.integers(0, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.white = np.zeros(256, bool)
        self.white[[32, 9, 10, 11, 12, 13]] = True
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def word_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words in a buffer of bytes, and where they start."""
        space = self.white[data]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        starts = np.flatnonzero(edge == -1)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        sizes = np.flatnonzero(np.diff(np.concatenate([space, [True]]).astype(np.int8)) == 1) + 1 - starts
        longest = int(sizes.max())
        while len(self.powers) < longest:
            self.powers = np.concatenate([self.powers, self.powers * self.base ** np.uint64(len(self.powers))])
        rank = np.arange(len(data)) - np.repeat(np.append(starts, 0), np.append(np.diff(np.append(starts, len(data))), 0)) if starts[0] == 0 else None
        if rank is None:
            rank = np.arange(len(data))
            rank[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        value = self.byte[self.low[data]] * self.powers[np.minimum(rank, longest - 1)]
        value[space] = 0
        return self.mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64)), starts

    def shingle_sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        h, starts = self.word_hashes(data)
        cut = np.searchsorted(starts, ends)
        out, at = [], 0
        k = self.size
        if len(h) >= k:
            s = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                s = s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
            s = self.mix(s)
        for end in cut.tolist():
            n = end - at
            if n >= k:
                out.append(np.unique(s[at : end - k + 1]))
            elif n:
                out.append(np.array([np.frombuffer(hashlib.md5(h[at:end].tobytes()).digest()[:8], np.uint64)[0]]))
            else:
                out.append(np.zeros(0, np.uint64))
            at = end
        return out

    def signature(self, found: np.ndarray) -> np.ndarray:
        x = (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            for j in range(0, len(self.a), 32):
                h = self.a[j : j + 32, None] * part + self.b[j : j + 32, None]
                least[j : j + 32] = np.minimum(least[j : j + 32], h.min(1))
        return least

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.bands, self.rows).astype(np.uint64)
        return self.mix((rows * self.mix_rows).sum(1) + np.arange(self.bands, dtype=np.uint64)).astype(np.int64)


def least_matches(threshold: float, batch: int, total: int, miss: float) -> list[int]:
    """After n = batch, 2 batch ... hashes: the fewest matches at which a pair stays.

    With a uniform prior the posterior of a match's probability is Beta(m + 1, n - m + 1); its tail
    beyond t is the probability of at most m successes in n + 1 trials of t. Bytes match by chance
    once in 256 times, so t is a little above the threshold.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(batch, total, batch), total]:
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def sketch(docs: DataFrame, scratch: Scratch, size: int, bands: int, rows: int) -> DataFrame:
    """(doc, d, n, cls, sig, keys, id) of each row: ``doc`` is its doc_id, ``d`` its text's digest, ``id`` numbers the rows."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(size, bands, rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                some, held, start = [], 0, at
                while at < batch.num_rows and held < 1 << 20:
                    some.append((texts[at].as_py() or "").encode("utf-8", "surrogatepass"))
                    held += len(some[-1])
                    at += 1
                sets = hasher.shingle_sets(some)
                sigs = [hasher.signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(some)),
                        batch.column(2).slice(start, len(some)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in sigs], pa.binary()),
                        pa.array([None if s is None else hasher.band_keys(s).tolist() for s in sigs], pa.list_(pa.int64())),
                    ],
                    names=["doc", "d", "n", "cls", "sig", "keys"],
                )

    each = plain(docs).mapInArrow(run, f"doc {dict(docs.dtypes)['doc_id']}, d binary, n long, cls binary, sig binary, keys array<long>")
    return scratch.table(each.withColumn("id", F.monotonically_increasing_id()), "sketch")


def plain(docs: DataFrame) -> DataFrame:
    """(doc, text, d): what tells rows apart, whatever their order."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("doc"), text.alias("text"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("d"))


def likely(pairs: DataFrame, sigs: DataFrame, limits: list[int], threshold: int, scratch: Scratch) -> DataFrame:
    """(a, b, m) of the pairs that the length bound and the sequential test leave; m: matching hashes."""
    side = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))

    def run(batches):
        for p in batches:
            if not len(p):
                continue
            x = np.frombuffer(b"".join(p["sig_a"]), np.uint8).reshape(len(p), -1)
            y = np.frombuffer(b"".join(p["sig_b"]), np.uint8).reshape(len(p), -1)
            left, m = np.arange(len(p)), np.zeros(len(p), np.int64)
            for k, least in enumerate(limits):
                cols = slice(k * BATCH, (k + 1) * BATCH)
                m[left] += (x[left, cols] == y[left, cols]).sum(1)
                left = left[m[left] >= least]
            yield pd.DataFrame({"a": p["a"].to_numpy()[left], "b": p["b"].to_numpy()[left], "m": m[left]})

    bound = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(bound).select("a", "b", "sig_a", "sig_b")
    return scratch.table(both.mapInPandas(run, "a long, b long, m long"), "likely")


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach ``threshold`` percent.

    Rows stream in the order (a, block, b): first a's text, then those of its partners. So a text goes
    once with each of its pairs as b, once for each block as a, and the partners of a hub are spread
    over blocks of about HUB of them.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = scratch.table(pairs.join(bounded(hubs), "a", "left").select("a", block.alias("block"), "b"), "placed")
    n = placed.count()
    partner = bounded(placed, n).join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "block", "b", "text")
    hub = bounded(placed.select("a", "block").distinct(), n).join(texts.select(F.col("id").alias("a"), "text"), "a")
    rows = partner.unionByName(hub.select("a", "block", F.lit(None).cast("long").alias("b"), "text"))

    def run(batches):
        import pyarrow as pa

        now, mine = None, set()
        for batch in batches:
            found = []
            for a, block, b, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                this = shingles(text.as_py(), size)
                if b is None:
                    now, mine = (a, block), this
                    continue
                if now != (a, block):
                    raise ValueError(f"the text of {a} is missing")
                both = len(mine & this)
                if 100 * both >= threshold * (len(mine) + len(this) - both):
                    found.append((a, b))
            cols = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    ordered = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return scratch.table(ordered.mapInArrow(run, "a long, b long"), "verified")


def in_blocks(members: DataFrame) -> DataFrame:
    """``members`` (key, id, root, main, n_main, n_rest, ...) dealt to blocks (key, kind, lo, hi), with ``side``.

    Members of a bucket's largest component (``main``) meet the others (kind 0), the others each other (kind 1);
    so where one component holds nearly all of a bucket, its members travel once and not once for each block.
    """
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    of = lambda c: F.pmod(F.xxhash64("id"), parts(c)).cast("int")
    block = lambda kind, lo, hi, side: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    every = lambda c: F.sequence(F.lit(0), parts(c) - 1)
    mine = F.transform(every("n_rest"), lambda j: block(0, of("n_main"), j, F.lit(0)))
    rest = F.concat(
        F.transform(every("n_main"), lambda i: block(0, i, of("n_rest"), F.lit(1))),
        F.transform(every("n_rest"), lambda j: block(1, F.least(of("n_rest"), j), F.greatest(of("n_rest"), j), of("n_rest"))),
    )
    placed = members.withColumn("p", F.explode(F.when(F.col("root") == F.col("main"), mine).otherwise(rest)))
    return placed.drop("main", "n_main", "n_rest").select("p.*", *[c for c in placed.columns if c not in ("p", "main", "n_main", "n_rest")])


def candidates(x: pd.DataFrame, y: pd.DataFrame, half: bool, limits: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, m): places in x and y of the pairs across components that the length bound and the sequential test leave."""
    table = lambda f: np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(len(f), -1)
    sx, sy = table(x), table(y)
    ix, iy, rx, ry, nx, ny = (f[c].to_numpy() for c in ("id", "root", "n") for f in (x, y))
    found = [np.zeros((3, 0), np.int64)]
    for at in range(0, len(x), 64):
        part = slice(at, at + 64)
        near = 100 * np.minimum(nx[part, None], ny) >= threshold * np.maximum(nx[part, None], ny)
        i, j = np.nonzero((rx[part, None] != ry[None, :]) & near)
        i = i + at
        if half:
            i, j = i[ix[i] < iy[j]], j[ix[i] < iy[j]]
        m = np.zeros(len(i), np.int64)
        for k, least in enumerate(limits):
            cols = slice(k * BATCH, (k + 1) * BATCH)
            m += (sx[i, cols] == sy[j, cols]).sum(1)
            i, j, m = i[m >= least], j[m >= least], m[m >= least]
        found.append(np.stack([i, j, m]))
    i, j, m = np.concatenate(found, axis=1)
    return i, j, m


def sides(p: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two sides of a block, and whether they are the same members."""
    kind, lo, hi = (p[c].iloc[0] for c in ("kind", "lo", "hi"))
    x, y = (p[p["side"] == k].sort_values("id") for k in ((lo, hi) if kind else (0, 1)))
    return x, y, bool(kind and lo == hi)


def block_links(members: DataFrame, limits: list[int], threshold: int) -> DataFrame:
    """(a, b): links that join components in large buckets, compared block by block on the sets of hashes.

    A pair is compared in the first band that it shares; likelier pairs come first, and a pair whose
    ends a block has joined already is skipped.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        key = p["key"].iloc[0]
        x, y, half = sides(p)
        links, up, sets = [], {}, {}

        def root(r):
            while up.get(r, r) != r:
                r = up[r]
            return r

        def shingled(f, k, side):
            if (side, k) not in sets:
                sets[side, k] = set(np.frombuffer(f["set"].iat[k], np.uint64).tolist())
            return sets[side, k]

        if len(x) and len(y):
            i, j, m = candidates(x, y, half, limits, threshold)
            kx, ky = (np.array(f["keys"].tolist(), np.int64).reshape(len(f), -1) for f in (x, y))
            first = kx[i][np.arange(len(i)), (kx[i] == ky[j]).argmax(1)] == key
            i, j, m = i[first], j[first], m[first]
            ix, iy, rx, ry = x["id"].to_numpy(), y["id"].to_numpy(), x["root"].to_numpy(), y["root"].to_numpy()
            order = np.argsort(-m, kind="stable")
            for i, j in zip(i[order].tolist(), j[order].tolist(), strict=True):
                r, t = root(rx[i]), root(ry[j])
                if r != t:
                    one, two = shingled(x, i, 0), shingled(y, j, 1)
                    both = len(one & two)
                    if 100 * both >= threshold * (len(one) + len(two) - both):
                        up[max(r, t)] = min(r, t)
                        links.append((min(ix[i], iy[j]), max(ix[i], iy[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return in_blocks(members).groupBy("key", "kind", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def with_main(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (key, id, root) of the buckets that hold several components, with main, n_main and n_rest."""
    each = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    mixed = each.select("key", F.col("top.root").alias("main"), F.col("top.n").alias("n_main"), (F.col("n") - F.col("top.n")).alias("n_rest")).where("n_rest > 0")
    return scratch.table(rows.join(bounded(scratch.table(mixed, "mixed")), "key"), "in-buckets")


def shingle_table(texts: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(id, set): the sorted shingle hashes of each text."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(size, 1, 1)
        for batch in batches:
            for ids, t in zip(batch.column(0), batch.column(1), strict=True):
                (found,) = hasher.shingle_sets([(t.as_py() or "").encode("utf-8", "surrogatepass")])
                yield pa.RecordBatch.from_arrays([pa.array([ids.as_py()], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["id", "set"])

    return scratch.table(texts.select("id", "text").mapInArrow(run, "id long, set binary"), "sets")


def linked(
    docs: DataFrame, scratch: Scratch, size: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS,
    miss: float = MISS, small: int = SMALL,
) -> DataFrame:
    """(doc, d, n, root) of each row: rows with one root are one component, as are all rows of an id."""
    docs = docs.select("doc_id", "text")
    limits = least_matches(threshold / 100, BATCH, bands * rows, miss)
    known = sketch(docs, scratch, size, bands, rows)
    full = known.where("n > 0 AND doc IS NOT NULL")
    classes = scratch.table(
        full.select("cls", "id").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    # representatives: a class of one is its own, so only members of the others are looked up
    copied = scratch.table(classes.where("copies > 1"), "copied")
    n_copied = copied.count()
    of = bounded(copied.select("cls", "rep"), n_copied)
    member = scratch.table(full.join(of, "cls").select("id", "rep", "doc", "d"), "members")
    # equal rows are of one class, and have one text between them
    again = member.groupBy("doc", "d").count().where("count > 1").limit(1).count() > 0
    reps = full.join(bounded(member.where("id <> rep").select("id")), "id", "left_anti")
    reps = scratch.table(reps.select("id", "n", "sig", "keys"), "reps")
    sigs = reps.select("id", "n", "sig")

    banded = reps.select("id", F.explode("keys").alias("key"))
    buckets = scratch.table(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1"), "buckets")
    inside = scratch.table(banded.join(bounded(buckets), "key"), "inside")
    star = inside.where("id <> a").select("a", F.col("id").alias("b"))
    few = inside.where(F.col("n").between(3, small)).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # at most small * (small - 1) / 2 pairs of each
    two = few.select(F.explode(F.expr("slice(ids, 2, size(ids))")).alias("a"), "ids")
    two = two.select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    pairs = scratch.table(star.unionByName(two).distinct(), "pairs")
    left = likely(pairs, sigs, limits, threshold, scratch)
    scratch.drop(pairs, buckets)

    involved = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = scratch.table(texts_of(docs, known, involved, again, scratch), "texts")
    best = scratch.table(left.groupBy("b").agg(F.min(F.struct((-F.col("m")).alias("m"), "a")).alias("x")).select("x.a", "b"), "best")
    labels = components(verified(best, texts, size, threshold, scratch), scratch)
    rest = between(left.join(best, ["a", "b"], "left_anti"), labels, scratch)
    if rest.limit(1).count():
        labels = components(verified(rest, texts, size, threshold, scratch), scratch, labels)
    scratch.drop(texts, left, best)

    large = with_roots(inside.where(F.col("n") > small).select("key", "id"), labels)
    large = with_main(large, scratch)  # buckets of one component are done
    scratch.drop(inside)
    if large.limit(1).count():
        texts = scratch.table(texts_of(docs, known, large.select("id").distinct(), again, scratch), "texts")
        due = large.join(reps.select("id", "n", "sig", "keys"), "id").join(shingle_table(texts, size, scratch), "id")
        links = scratch.table(block_links(due, limits, threshold), "links")
        # blocks compare hashed sets; what they found is confirmed on the texts
        labels = components(verified(links, texts, size, threshold, scratch), scratch, labels)
        scratch.drop(texts, links)

    # classes: members have the root of their representative
    of_rep = bounded(labels.select(F.col("id").alias("rep"), "root"))
    placed = known.select("id", "doc", "d", "n").join(bounded(member.select("id", "rep")), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    placed = scratch.table(placed.join(of_rep, "rep", "left").select("doc", "d", "n", F.coalesce("root", "rep").alias("root")), "placed")
    # an id with several rows may stand in several components: they are one
    spread = placed.where("doc IS NOT NULL").groupBy("doc").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z")
    spread = scratch.table(spread.select("doc", "a"), "spread")
    n_spread = spread.count()
    if n_spread:
        shared = placed.select("doc", F.col("root").alias("b")).join(bounded(spread, n_spread), "doc").where("a <> b").select("a", "b")
        final = components(shared, scratch).select(F.col("id").alias("root"), F.col("root").alias("up"))
        placed = scratch.table(placed.join(bounded(final), "root", "left").select("doc", "d", "n", F.coalesce("up", "root").alias("root")), "placed")
    return placed


def near_duplicates(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id of its component), kept."""
    placed = linked(docs, scratch, **options)
    named = placed.where("doc IS NOT NULL").groupBy("doc").agg(F.max("n").alias("n_shingles"), F.min("root").alias("root"))
    each = scratch.table(named, "each")
    first = scratch.table(each.groupBy("root").agg(F.min("doc").alias("least"), F.count("*").alias("ids")).where("ids > 1"), "first")
    out = each.join(bounded(first.select("root", "least")), "root", "left").select(
        F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("least", "doc").alias("component_id")
    )
    # rows without an id: one row each
    alone = placed.where("doc IS NULL").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    out = out.unionByName(alone)
    return scratch.table(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")


def texts_of(docs: DataFrame, known: DataFrame, ids: DataFrame, again: bool, scratch: Scratch) -> DataFrame:
    """(id, text) of the rows with these numbers. ``again``: there are equal rows, of which one is enough."""
    wanted = scratch.table(known.select("id", F.col("doc").alias("doc_"), F.col("d").alias("d_")).join(bounded(ids), "id", "left_semi"), "wanted")
    found = plain(docs).join(bounded(wanted), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("d") == F.col("d_"))).select("id", "text")
    return found.dropDuplicates(["id"]) if again else found


def with_roots(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(bounded(labels), "id", "left").withColumn("root", F.coalesce("root", "id"))


def between(pairs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs whose ends are in different components."""
    few = bounded(labels)
    for c in ("a", "b"):
        pairs = pairs.join(few.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return scratch.table(pairs.where(apart).select("a", "b"), "apart")


def keep_one(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component."""
    name = free_name(docs.columns, "gone_id")
    gone = near_duplicates(docs, scratch, **options).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name))
    return docs.join(bounded(gone), docs["doc_id"] == F.col(name), "left_anti")
