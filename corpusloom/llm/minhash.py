"""Near-duplicate documents: b-bit MinHash, multi-index Hamming join, exact confirmation.

A document's set is its distinct 5-word shingles. It is summarised by 256 one-byte MinHash
symbols. The first 66 are dealt into 11 chunks of 6. Two signatures that differ there in at most 21
symbols differ, by pigeonhole, in at most one symbol of some chunk; so each chunk is indexed under
its 6 one-error patterns (five exact symbols and a wildcard), which finds every pair within the
distance. A pair of sets with Jaccard similarity 0.85 has an expected distance of 9.9 there and
exceeds 21 with a probability below 3e-4. Over all 256 symbols it has 38, and exceeds 62 with a
probability below 3e-5; candidates beyond that are not worth reading their texts.

Texts of the same words in the same order are one class from the start, known by a cryptographic digest of them. A
bucket of the index is resolved without listing its pairs: each member is first compared with the bucket's
smallest id; only buckets that still hold several components are searched for pairs between components that are
within the distance, in tiles of bounded size. A tile gives a forest of these pairs, not all of them. The trees make
clusters, whose texts meet in tiles and give a forest of their links. Hashes only propose: links are confirmed on the
full sets, whose shingles are told apart by their words themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import components, materialize, release, sift

SHINGLE = 5
CHUNKS, WIDTH = 11, 6
INDEXED, SYMBOLS = CHUNKS * WIDTH, 256
DISTANCE = 21  # among the indexed symbols; at most 2 * CHUNKS - 1, so that some chunk has at most one error
FULL_DISTANCE = 62  # among all symbols
PERCENT = 85
#: Members of one leader that are compared in one task; of a leader with more than FAN ** 2 members, the root of their number.
FAN = 256
#: Parts that the pairs of a leader with more than FAN members are dealt into before they are joined.
SPREAD = 256
#: Rows of a bucket on each side of a tile.
TILE = 2048
#: Texts of a cluster on each side of a tile, and their shingles, on average.
BLOCK, BLOCK_SHINGLES = 256, 500_000
#: Five numbers below this make one number below 2 ** 63.
RADIX = 6208
_MASK = (1 << 64) - 1
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _mix(seed: int) -> int:
    z = (seed + 0x9E3779B97F4A7C15) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


_XOR = np.array([_mix(2000 + i) & 0xFFFFFFFF for i in range(SYMBOLS)], np.uint32)
_MUL = np.array([(_mix(3000 + i) & 0xFFFFFFFF) | 1 for i in range(SYMBOLS)], np.uint32)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_numbers(texts: list[np.ndarray], radix: int, k: int = SHINGLE) -> list[np.ndarray]:
    """A number for each shingle of texts given as numbers of words from 1 to radix - 1; equal if and only if the words are.

    A text of fewer than k words is one shingle, which equals no longer one. Where the digits would not fit, what
    has been read of the shingles is numbered anew, over all texts together.
    """
    filled = [np.concatenate([np.zeros(k - len(t), np.int64), t]) if 0 < len(t) < k else t for t in texts]  # 0 is no word
    counts = [max(len(t) - k + 1, 0) for t in filled]
    key, below = np.zeros(sum(counts), np.int64), 1
    for j in range(k):
        if below * radix >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            below = int(key.max(initial=0)) + 1
        key, below = key * radix + np.concatenate([t[j : j + n] for t, n in zip(filled, counts, strict=True)]), below * radix
    return np.split(key, np.cumsum(counts)[:-1])


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each distinct shingle; two shingles with one hash are still two."""
    if not words:
        return np.zeros(0, np.uint64)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
    (key,) = shingle_numbers([ids], len(numbers) + 1)
    first = np.unique(key, return_index=True)[1]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)[ids - 1]
    h = np.full(len(first), min(SHINGLE, len(words)), np.uint64)
    for j in range(min(SHINGLE, len(words))):
        h = (h ^ hashes[first + j]) * _M1
        h ^= h >> np.uint64(32)
        h *= _M2
        h ^= h >> np.uint64(29)
    return h


class Leader:
    """The shingle sets of the texts of one document, with which others are compared exactly."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.texts: list[np.ndarray] = []
        self.sets: list[np.ndarray] | None = None

    def add(self, words: list[bytes]) -> None:
        ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
        if not any(np.array_equal(ids, t) for t in self.texts):
            self.texts.append(ids)
            self.sets = None

    def near(self, words: list[bytes]) -> bool:
        """Whether a text of these words is linked with one of the document's."""
        new: dict[bytes, int] = {}
        known, base = self.numbers, len(self.numbers) + 1
        ids = np.array([known.get(w) or new.setdefault(w, base + len(new)) for w in words], np.int64)
        radix = base + len(new)
        if radix <= RADIX:
            if self.sets is None:
                self.sets = [np.unique(x) for x in shingle_numbers(self.texts, RADIX)]
            own, other = self.sets, np.unique(shingle_numbers([ids], RADIX)[0])
        else:
            *own, other = (np.unique(x) for x in shingle_numbers([*self.texts, ids], radix))
        for one in own:
            few, many = sorted((len(one), len(other)))
            if few and 100 * few >= PERCENT * many:
                both = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * both >= PERCENT * (few + many - both):
                    return True
        return False


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """One-byte MinHash symbols of non-empty sets, a row each."""
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    low = np.concatenate(sets).astype(np.uint32)
    out = np.empty((len(sets), SYMBOLS), np.uint8)
    for i in range(SYMBOLS):
        x = low ^ _XOR[i]
        x *= _MUL[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(x, at)
        least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        out[:, i] = (least >> np.uint32(24)).astype(np.uint8)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])


def _sign(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at, n = 0, batch.num_rows
        while at < n:
            sets, fps, here = [], [], at
            total = 0
            while at < n and total < 2_000_000:
                words = words_of(texts[at].as_py())
                sets.append(shingle_hashes(words))
                fps.append(hashlib.blake2b(b" ".join(words), digest_size=20).digest() if words else None)
                total += len(sets[-1])
                at += 1
            filled = [s for s in sets if len(s)]
            signed = iter(signature(filled)) if filled else iter(())
            sigs = [next(signed).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([ids.slice(here, at - here).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], schema=_SIGNED)


def _keys(batches):
    """Rows (key, rep) of the multi-index for rows (rep, sig)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
        reps = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        keys = np.empty((n, INDEXED), np.int64)
        for c in range(CHUNKS):
            for j in range(WIDTH):
                key = np.full(n, (c * WIDTH + j) << 40)
                for q, p in enumerate(x for x in range(WIDTH) if x != j):
                    key |= sig[:, c * WIDTH + p] << (8 * q)
                keys[:, c * WIDTH + j] = key
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(reps, INDEXED))], ["key", "rep"])


def _cross(batches):
    """A forest of the pairs of different components in one bucket within the distance, each pair in its first common bucket only.

    Takes rows (key, i, j, block, comp, rep, sig) sorted by tile (key, i, j): rows of block i meet those of block j. Of a tile's
    pairs only those come out that join two trees, so fewer than it has rows; every rep that is in a pair is in a tree with its partners.
    """
    held: list[tuple] = []
    out: list[tuple[int, int]] = []

    def resolve():
        if len(held) < 2:
            return
        number, (i, j) = held[0][0] >> 40, held[0][1:3]
        block = np.array([h[3] for h in held])
        comp, rep = np.array([h[4] for h in held]), np.array([h[5] for h in held])
        sig = np.frombuffer(b"".join(h[6] for h in held), np.uint8).reshape(len(held), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        tree = np.unique(rep, return_inverse=True)[1]
        for at, own in enumerate(left):
            others = right[at + 1 :] if i == j else right
            others = others[(comp[others] != comp[own]) & (tree[others] != tree[own])]
            if not len(others):
                continue
            differ = sig[others] != sig[own]
            near = differ[:, :INDEXED].sum(1) <= DISTANCE
            near &= differ.sum(1) <= FULL_DISTANCE
            others, differ = others[near], differ[near, :INDEXED].reshape(-1, CHUNKS, WIDTH)
            if len(others):
                errors = differ.sum(2)
                chunk = (errors <= 1).argmax(1)
                rows = np.arange(len(others))
                first = chunk * WIDTH + np.where(errors[rows, chunk] == 1, differ[rows, chunk].argmax(1), 0)
                for o in others[first == number]:
                    if tree[o] != tree[own]:
                        tree[tree == tree[o]] = tree[own]
                        out.append((min(rep[own], rep[o]), max(rep[own], rep[o])))
                if len(out) > 20000:
                    yield flush()

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield from resolve()
                held.clear()
            held.append(row)
    yield from resolve()
    yield flush()


def _linked(batches):
    """A forest of the links between different components in one cluster, confirmed on the full sets.

    Takes rows (cluster, i, j, block, comp, node, text) sorted by tile (cluster, i, j): texts of block i meet those of block j.
    """
    held: list[tuple] = []

    def resolve():
        i, j = held[0][1:3]
        numbers: dict[bytes, int] = {}
        texts = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(h[6])], np.int64) for h in held]
        sets = [np.unique(x) for x in shingle_numbers(texts, len(numbers) + 1)]
        size = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sets = np.split(ids, np.cumsum(size)[:-1])
        seen = np.zeros(len(ids) + 1, bool)
        block, node = np.array([h[3] for h in held]), [h[5] for h in held]
        tree = np.unique([h[4] for h in held], return_inverse=True)[1]
        left, right = np.flatnonzero((block == i) & (size > 0)), np.flatnonzero((block == j) & (size > 0))
        a, b = [], []
        for at, own in enumerate(left):
            others = right[at + 1 :] if i == j else right
            others = others[tree[others] != tree[own]]
            few, many = np.minimum(size[others], size[own]), np.maximum(size[others], size[own])
            others = others[100 * few >= PERCENT * many]
            if not len(others):
                continue
            seen[sets[own]] = True
            both = np.add.reduceat(seen[np.concatenate([sets[o] for o in others])], np.concatenate([[0], np.cumsum(size[others])[:-1]]), dtype=np.int64)
            seen[sets[own]] = False
            for o in others[100 * both >= PERCENT * (size[others] + size[own] - both)]:
                if tree[o] != tree[own]:
                    tree[tree == tree[o]] = tree[own]
                    a.append(node[own])
                    b.append(node[o])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield resolve()
                held.clear()
            if not held or held[-1] != row:  # repeated rows
                held.append(row)
    if held:
        yield resolve()


def _confirm(batches):
    """Links among rows (leader, salt, member, text) sorted so that each leader's own texts (member null) come first."""
    own, key = None, None
    a, b = [], []
    for batch in batches:
        for lead, salt, member, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (lead, salt):
                own, key = Leader(), (lead, salt)
            if member is None:
                own.add(words_of(text))
            elif own.near(words_of(text)):
                a.append(lead)
                b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = [], []


def dealt(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b) with a salt, so that no (a, salt) has many more than FAN members.

    The pairs of a leader with more than FAN members are in SPREAD parts when they learn the number of its salts, so
    that they never meet in one task. The table of those leaders, once for each part, has at most as many rows as there are pairs.
    """
    n = F.col("n")
    common = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(n > FAN)
    salts = common.select("a", F.ceil(n / F.greatest(F.lit(float(FAN)), F.sqrt(n))).cast("int").alias("salts"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    parts = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    return parts.join(salts, ["a", "part"], "left").select("a", F.coalesce(F.pmod(F.xxhash64("b", F.lit(1)), "salts"), F.lit(0)).cast("int").alias("salt"), "b")


def within(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The dealt `pairs` (a, salt, b) whose signatures (rep, sig) are within both distances."""
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    signatures = sift(signatures, "rep", materialize(ids, "ids"))
    leaders = pairs.select("a", "salt").distinct().join(signatures.toDF("a", "sa"), "a")
    return pairs.join(leaders, ["a", "salt"]).join(signatures.toDF("b", "sb"), "b").select("a", "salt", "b", "sa", "sb").mapInArrow(_within, "a long, salt int, b long")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the dealt `pairs` (a, salt, b) whose full shingle sets meet the threshold.

    A leader's text goes once to each of its salts, the members' texts beside it; so no leader, however
    common, meets all its members in one task. Most texts that are in no pair are left out before all others are fetched by one join.
    """
    none = F.lit(None).cast("long")
    wanted = pairs.select("a", "salt").distinct().select(F.col("a").alias("id"), "a", "salt", none.alias("b")).unionByName(pairs.select(F.col("b").alias("id"), "a", "salt", "b"))
    texts = sift(docs.select(F.col("doc_id").alias("id"), "text"), "id", wanted.select("id").distinct())
    rows = wanted.join(texts, "id").select("a", "salt", "b", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_confirm, "a long, b long")


def united(pairs: DataFrame, comps: DataFrame, sizes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join the components (node, comp) of the `pairs`' documents as all links between documents of a cluster would.

    A cluster is what the pairs connect. Its texts are dealt into blocks, and each two blocks meet in one task; sizes (node, size) are
    shingles. A text is sent once for each block of its cluster, most once.
    """
    trees = components(pairs)
    nodes = trees.unionByName(trees.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "cluster")
    nodes = materialize(nodes, "clusters")
    known = sift(sizes, "node", nodes.select("node"))
    nodes = materialize(nodes.join(comps, "node").join(known, "node"), "clusters")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    nodes = materialize(nodes.join(nodes.groupBy("cluster").agg(blocks.alias("blocks")), "cluster"), "clusters")  # so that the size of the join with the texts is known beforehand
    texts = sift(docs.select(F.col("doc_id").alias("node"), "text"), "node", nodes.select("node"))
    rows = nodes.join(texts, "node").withColumn("block", F.pmod(F.xxhash64("node", "text"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "node", "text")
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node", "text").mapInArrow(_linked, "a long, b long")


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (digest of the shingle set) and sig of each document; fp and sig are null for empty sets."""
    return docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, n_shingles long, fp binary, sig binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text).

    Null and empty texts have no shingles and link with nothing; texts with equal sets are linked;
    a row without doc_id links nothing and is kept on its own with a null component_id; repeated rows
    give repeated rows. Rows that share a doc_id are one document: what links with any of their texts links with
    it, and each row has the n_shingles of its own text. Other columns are ignored. An empty table gives an empty result.
    """
    rows = materialize(signed(docs), "signed")
    classes = rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    reps = materialize(classes, "classes")
    keys = reps.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    bucket = Window.partitionBy("key")
    shared = keys.withColumn("leader", F.min("rep").over(bucket)).withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1").drop("n")
    shared = materialize(shared, "buckets")
    first = shared.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    signatures = reps.select("rep", "sig")
    unique = docs.select("doc_id", "text").where("doc_id is not null")
    pairs = materialize(within(dealt(first), signatures), "pairs")
    links = materialize(confirmed(pairs, unique), "links")
    release(pairs)
    found = components(links)
    label = F.coalesce("component", "rep")
    members = shared.select("key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("key", label.alias("comp"), "rep")
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    mixed = mixed.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    tiled = members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = materialize(tiled, "tiles")
    tiled = tiles.join(sift(signatures, "rep", tiles.select("rep").distinct()), "rep").select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "rep", "sig")
    rest = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(_cross, "a long, b long")
    rest = materialize(rest.distinct(), "pairs")
    sizes = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("size"))
    more = materialize(united(rest, tiles.select(F.col("rep").alias("node"), "comp").distinct(), sizes, unique), "links")
    release(rest, tiles, shared)
    found = components(links.unionByName(more))
    roots = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", label.alias("component_id"))
    joined = rows.join(roots, "fp", "left")
    component = F.when(F.col("fp").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _within(batches):
    """Of rows (a, salt, b, sa, sb) the pairs within both distances."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            differ = x != y
            near = pa.array((differ[:, :INDEXED].sum(1) <= DISTANCE) & (differ.sum(1) <= FULL_DISTANCE))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "salt", "b")], ["a", "salt", "b"])


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, counted; links closed by recursion.
ORACLE_MINHASH = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM said),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
