"""Suffix-array dedup: a distributed merge sort of front-coded suffix runs that never re-compares known prefixes.

A byte goes if a 100-byte window covers it that also starts earlier in the corpus. Sorting every
suffix would move the corpus a hundred times, so only anchored suffixes are sorted: a window's
anchor is its 16-byte string of least hash, and equal windows have their anchors at the same place. The
windows of one anchor form at most two units, each with a base position so that all its windows
share the 58 bytes from the base on.

1. Documents are dealt into runs by a hash of doc_id. Each run sends the hashes of its units' shared
   58 bytes, sorted and delta-coded; hashes that two runs have come back as bit maps. Units that no
   other unit can match go no further.
2. Each run settles its own repeated windows, which hashes bring together and their bytes confirm, and of the windows that it has first
   sends sorted, front-coded runs of units: suffixes from the base on, with the few bytes before it.
3. A loser tree merges the runs of a partition. It keeps for each entry how many bytes it is known to
   share with the last winner (for the next of the same run that is its front code) and compares only
   beyond; that also yields the common prefixes by which equal windows are found next to each other,
   compared byte by byte and settled for the earliest.
4. What is to go returns to the runs, which cut it out.

A string that is in a third of all documents enters the merge once for each run that holds it. All three
readings of the text share one exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import partitions, text_bytes

WINDOW, GRAM = 100, 16
REACH = WINDOW - GRAM  # greatest distance of a window's start before its anchor
HALF = 42  # greatest distance of a window's start before its unit's base
SHARED = WINDOW - HALF
RUN_BYTES = 4 << 20
#: Bytes of text for each segment of the hashes and each partition of the merge.
PIECE_BYTES = 128 << 20
_BLOCK = 1 << 20
_DROPPED = 16  # low bits of a hash that are not sent; fewer bits only make more candidates
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PAD = 128
_RUN = "__run"


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


class Run:
    """The texts of one run as one buffer, in order of doc_id (null first), then text."""

    def __init__(self, ids: list, texts: list):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t) for t in texts]
        self.order = sorted(range(len(raw)), key=lambda i: (ids[i] is not None, ids[i] or 0, raw[i]))
        raw = [raw[i] for i in self.order]
        self.ids = np.array([-(1 << 63) if ids[i] is None else ids[i] for i in self.order], np.int64)
        sizes = np.array([len(r) for r in raw], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.data = b"".join(raw)
        self.buffer = np.frombuffer(self.data + bytes(_PAD), np.uint8)
        self.words = np.ndarray((len(self.buffer) - 8,), np.dtype("<u8"), self.buffer.data, 0, (1,))

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base, first and last window start of each unit, in order; found for about a megabyte of documents at a time."""
        found, i = [(np.zeros(0, np.int64),) * 3], 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.begin, self.begin[i] + _BLOCK, side="right")) - 1)
            found.append(self._units(i, j))
            i = j
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _units(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units of the documents i to j - 1."""
        begin = int(self.begin[i])
        n = int(self.begin[j]) - begin
        ends = self.begin[i + 1 : j + 1] - begin
        sizes = np.diff(self.begin[i : j + 1])
        starts = np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(ends, sizes))
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        width = REACH + 1
        h = self.words[begin : begin + n] * _M1
        h ^= self.words[begin + 8 : begin + n + 8] * _M3
        h = _mixed(h)
        h &= np.uint64(0xFFFFFFFF00000000)
        h |= np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = h
        grid = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[width - 1 : n + width - 1])[starts]
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        far = anchor - starts > HALF  # the windows that start further before their anchor
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        base = anchor[first] - np.where(far[first], HALF + 1, 0)
        return base + begin, starts[first] + begin, starts[last] + begin

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """64-bit hashes of the `length` bytes at each place."""
        h = np.full(len(at), length, np.uint64) * _M1
        for k in [*range(0, length - 7, 8), length - 8]:
            h ^= self.words[at + k]
            h *= _M3
            h ^= h >> np.uint64(31)
        return _mixed(h)

    def repeated(self, windows: np.ndarray) -> np.ndarray:
        """Whether the bytes of each window are also those of one before it in `windows`, which are in order of place."""
        h = self.hashes(windows, WINDOW)
        order = np.argsort(h, kind="stable")
        out = np.zeros(len(windows), bool)
        at = np.flatnonzero(h[order][1:] == h[order][:-1]) + 1
        one, other = windows[order[at]], windows[order[at - 1]]
        same = np.ones(len(at), bool)
        for k in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
            same &= self.words[one + k] == self.words[other + k]
        out[order[at]] = same
        for i in np.unique(h[order[at[~same]]]):  # one hash of different bytes
            seen = set()
            for j in np.flatnonzero(h == i):
                bytes_ = self.data[windows[j] : windows[j] + WINDOW]
                out[j] = bytes_ in seen
                seen.add(bytes_)
        return out

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1


def _pack(*arrays: np.ndarray) -> bytes:
    """The arrays, little-endian and in byte planes, compressed."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        out.append(len(a).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes())
    return zstandard.compress(b"".join(out), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n, size = int.from_bytes(raw[at : at + 8], "little"), np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at + 8).reshape(size, n).T
        out.append(np.ascontiguousarray(planes).view(kind).reshape(n))
        at += 8 + n * size
    return out


def _sent_keys(run: Run, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each unit's shared bytes, and the sorted distinct ones."""
    keys = run.hashes(base, SHARED) >> np.uint64(_DROPPED)
    return keys, np.unique(keys)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    """Bounds of each segment in sorted keys."""
    edges = [(i << (64 - _DROPPED)) // segments for i in range(1, segments)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def _load(table: pa.Table) -> Run:
    return Run(table.column("doc_id").to_pylist(), table.column("text").to_pylist())


def _announce(segments: int):
    def run(key, table):
        own = _load(table)
        _, distinct = _sent_keys(own, own.units()[0])
        bounds = _segment(distinct, segments)
        full = [s for s in range(segments) if bounds[s + 1] > bounds[s]]
        blobs = [_pack(np.diff(distinct[bounds[s] : bounds[s + 1]], prepend=np.uint64(0))) for s in full]
        return pa.table({"segment": pa.array(full, pa.int32()), "run": pa.array([key[0].as_py()] * len(full), pa.int32()), "keys": pa.array(blobs, pa.binary())})

    return run


def _shared_keys(key, table):
    runs = table.column("run").to_pylist()
    keys = [np.cumsum(_unpack(b, "<u8")[0]) for b in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    runs_out, bits = [], []
    for run, own in zip(runs, keys, strict=True):
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        hit = twice[at] == own if len(twice) else np.zeros(len(own), bool)
        if hit.any():
            runs_out.append(run)
            bits.append(zstandard.compress(np.packbits(hit).tobytes(), 1))
    return pa.table({"run": pa.array(runs_out, pa.int32()), "segment": pa.array([key[0].as_py()] * len(runs_out), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is of."""
    sizes = last - first + 1
    which = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which], which


def _offer(segments: int, targets: int):
    """Settles a run's own repeats; sends them (kind 1) and sorted front-coded runs of the units left (kind 0)."""

    def run(key, table, bitmaps):
        own = _load(table)
        number = key[0].as_py()
        base, first, last = own.units()
        keys, distinct = _sent_keys(own, base)
        bounds = _segment(distinct, segments)
        elsewhere = np.zeros(len(distinct), bool)
        for s, blob in zip(bitmaps.column("segment").to_pylist(), bitmaps.column("bits").to_pylist(), strict=True):
            size = int(bounds[s + 1] - bounds[s])
            elsewhere[bounds[s] : bounds[s + 1]] = np.unpackbits(np.frombuffer(zstandard.decompress(blob), np.uint8), count=size).astype(bool)
        at = np.searchsorted(distinct, keys)
        abroad = elsewhere[at]
        alive = abroad | (np.bincount(at, minlength=len(distinct))[at] > 1)
        base, first, last, keys, abroad = base[alive], first[alive], last[alive], keys[alive], abroad[alive]
        windows, unit = _ranges(first, last)
        repeated = own.repeated(windows)
        gone = windows[repeated]
        rows = [(number % targets, number, 1, _spans_blob(own, gone, gone + WINDOW))]
        # units with windows that this run has first and another run may have too
        left = ~repeated & abroad[unit]
        if left.any():
            mine, where = np.unique(unit[left], return_inverse=True)
            lo, hi = np.full(len(mine), 1 << 62), np.full(len(mine), -1)
            np.minimum.at(lo, where, windows[left])
            np.maximum.at(hi, where, windows[left])
            rows += [(t, number, 0, blob) for t, blob in _coded_runs(own, base[mine], lo, hi, keys[mine], targets)]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["target", "run", "kind", "blob"])

    return run


def _spans_blob(run: Run, start: np.ndarray, end: np.ndarray) -> bytes:
    """(document's place in the run, start and end in it) of spans, after joining those that touch."""
    if len(start):
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        document = run.document(start)
        new = np.concatenate([[True], (start[1:] > end[:-1]) | (document[1:] != document[:-1])])
        at = np.flatnonzero(new)
        start, end, document = start[at], end[np.concatenate([at[1:], [len(start)]]) - 1], document[at]
        return _pack(document.astype("<i4"), (start - run.begin[document]).astype("<i8"), (end - run.begin[document]).astype("<i8"))
    return _pack(np.zeros(0, "<i4"), np.zeros(0, "<i8"), np.zeros(0, "<i8"))


def _coded_runs(run: Run, base, lo, hi, keys, targets):
    """For each target, the units sorted by their suffixes and front-coded."""
    data, target = run.data, (keys % np.uint64(targets)).astype(np.int64)
    suffix = [data[b : h + WINDOW] for b, h in zip(base.tolist(), hi.tolist(), strict=True)]
    document = run.document(base)
    place, ids = base - run.begin[document], run.ids[document]
    order = sorted(range(len(suffix)), key=lambda i: (target[i], suffix[i]))
    ordered = target[order]
    for t in np.unique(ordered):
        a, b = np.searchsorted(ordered, t), np.searchsorted(ordered, t, side="right")
        part = order[a:b]
        known, rest, before, last = [], [], [], b""
        for i in part:
            s = suffix[i]
            k = _common(last, s, 0)
            known.append(k)
            rest.append(s[k:])
            before.append(data[lo[i] : base[i]])
            last = s
        at = np.array(part)
        yield int(t), _pack(
            np.array(known, np.uint8), np.array([len(r) for r in rest], np.uint8), np.array([len(x) for x in before], np.uint8),
            ids[at].astype("<i8"), document[at].astype("<i4"), place[at].astype("<i8"), np.frombuffer(b"".join(rest), np.uint8), np.frombuffer(b"".join(before), np.uint8),
        )


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)


def decoded(blob: bytes, run: int):
    """Entries (suffix, bytes shared with the entry before, bytes before the base, (doc_id, document, place), run) of a front-coded run."""
    known, sizes, reach, ids, document, place, rest, before = _unpack(blob, "u1", "u1", "u1", "<i8", "<i4", "<i8", "u1", "u1")
    rest, before, at, back, last = rest.tobytes(), before.tobytes(), 0, 0, b""
    for k, n, r, i, d, p in zip(known.tolist(), sizes.tolist(), reach.tolist(), ids.tolist(), document.tolist(), place.tolist(), strict=True):
        last = last[:k] + rest[at : at + n]
        yield last, k, before[back : back + r], (i, d, p), run
        at += n
        back += r


def merged(runs: list):
    """Merges sorted runs of entries; yields (entry, bytes shared with the entry yielded before).

    A tree of losers: each inner node keeps the run that lost there and how many bytes its entry shares
    with the winner it lost to. A challenger that shares more with the last winner than the loser
    does is smaller, one that shares less is greater; only equals are compared, from that byte on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    iterators = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    heads = [next(it, None) for it in iterators]
    loser, shares = [0] * k, [0] * k

    def duel(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """winner, its shared bytes, loser, the bytes it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, hb, a, 0
        if y is None:
            return a, ha, b, 0
        if ha != hb:
            return (a, ha, b, hb) if ha > hb else (b, hb, a, ha)
        x, y = x[0], y[0]
        c = _common(x, y, ha)
        if c == len(x) or (c < len(y) and x[c] < y[c]):
            return a, ha, b, c
        return b, hb, a, c

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        a, ha = play(2 * node)
        b, hb = play(2 * node + 1)
        winner, h, loser[node], shares[node] = duel(a, ha, b, hb)
        return winner, h

    winner, h = play(1) if k > 1 else (0, 0)
    while (entry := heads[winner]) is not None:
        yield entry, h
        following = next(iterators[winner], None)
        heads[winner] = following
        h = following[1] if following is not None else 0
        node = (winner + k) >> 1
        while node:
            other, ho = loser[node], shares[node]
            if heads[other] is not None and (following is None or ho > h):  # decided without a look at the bytes
                loser[node], shares[node] = winner, h if following is not None else 0
                winner, h, following = other, ho, heads[other]
            elif ho == h and following is not None and heads[other] is not None:
                winner, h, loser[node], shares[node] = duel(winner, h, other, ho)
                following = heads[winner]
            node >>= 1


def settled(group: list):
    """Spans (run, document, start, end) of the windows of one group of units that an earlier unit has too."""
    classes: dict[tuple[bytes, bytes], tuple] = {}
    for suffix, _, before, place, run in group:
        key = (before, suffix)
        old = classes.get(key)
        if old is None:
            classes[key] = (place, run)
            continue
        late = (place, run)
        if place < old[0]:
            classes[key], late = late, old
        (_, document, base), r = late
        yield r, document, base - len(before), base + len(suffix)
    if len(classes) < 2:
        return
    owner: dict[tuple[int, bytes], tuple] = {}
    for (before, suffix), (place, _) in classes.items():
        whole, n = before + suffix, len(before)
        for d in range(len(whole) - WINDOW + 1):
            window = (n - d, whole[d : d + WINDOW])
            if window not in owner or place < owner[window]:
                owner[window] = place
    for (before, suffix), (place, run) in classes.items():
        whole, n = before + suffix, len(before)
        _, document, base = place
        for d in range(len(whole) - WINDOW + 1):
            if owner[n - d, whole[d : d + WINDOW]] != place:
                yield run, document, base - n + d, base - n + d + WINDOW


def _settle(key, table):
    rows = list(zip(*(table.column(c).to_pylist() for c in ("run", "kind", "blob")), strict=True))
    spans: dict[int, list[tuple[int, int, int]]] = {}
    group: list = []
    for entry, shared in merged([decoded(blob, run) for run, kind, blob in sorted((r for r in rows if r[1] == 0), key=lambda r: r[0])]):
        if shared < SHARED:
            if len(group) > 1:
                for run, *span in settled(group):
                    spans.setdefault(run, []).append(tuple(span))
            group = []
        group.append(entry)
    if len(group) > 1:
        for run, *span in settled(group):
            spans.setdefault(run, []).append(tuple(span))
    runs, blobs = [r[0] for r in rows if r[1] == 1], [r[2] for r in rows if r[1] == 1]
    for run, found in spans.items():
        document, start, end = (np.array(x) for x in zip(*found, strict=True))
        runs.append(run)
        blobs.append(_pack(document.astype("<i4"), start.astype("<i8"), end.astype("<i8")))
    return pa.table({"run": pa.array(runs, pa.int32()), "spans": pa.array(blobs, pa.binary())})


#: What `deduplicate` can return of the bytes that stay, and its type.
KEPT = {"kept": pa.binary(), "kept_text": pa.string(), "kept_sha256": pa.string()}


def _cut(kept: str, prefix: str):
    """Rows of a run with n_bytes, n_removed, n_spans and what stays: the bytes, their text or their digest."""

    def run(key, table, spans):
        own = _load(table)
        n = len(own.data)
        change = np.zeros(n + 1, np.int32)
        for blob in spans.column("spans").to_pylist():
            document, start, end = _unpack(blob, "<i4", "<i8", "<i8")
            np.add.at(change, own.begin[document] + start, 1)
            np.add.at(change, own.begin[document] + end, -1)
        removed = np.cumsum(change[:-1], dtype=np.int32) > 0
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inside = own.begin[:-1][own.begin[:-1] < n]
        opens[inside] = removed[inside]
        per = []
        for flags in (removed, opens):
            at = np.flatnonzero(flags)
            per.append(np.diff(np.searchsorted(at, own.begin)))
        stay = [own.buffer[b:e][~removed[b:e]].tobytes() for b, e in zip(own.begin[:-1], own.begin[1:], strict=True)]
        if kept == "kept_sha256":
            stay = [hashlib.sha256(s).hexdigest() for s in stay]
        elif kept == "kept_text":
            stay = [s.decode("utf-8", "ignore") for s in stay]
        out = table.take(pa.array(own.order, pa.int64())).drop_columns([_RUN, *(["text"] if kept == "kept_sha256" else [])])
        added = (("n_bytes", np.diff(own.begin), pa.int64()), ("n_removed", per[0], pa.int64()), ("n_spans", per[1], pa.int64()), (kept, stay, KEPT[kept]))
        for name, values, kind in added:
            out = out.append_column(prefix + name, pa.array(values, kind))
        return out

    return run


def deduplicate(docs: DataFrame, kept: str = "kept", prefix: str = "") -> DataFrame:
    """Each row of `docs` (doc_id, text, ...) with n_bytes, n_removed, n_spans and `kept`, the bytes that stay.

    With kept="kept_text" they are text, without the characters that lost some of their bytes; with
    kept="kept_sha256" their digest takes the place of text and bytes. Null and empty texts have no
    bytes; a null doc_id comes before all others; rows with the same doc_id come in order of their texts
    and repeat each other like any. The added names begin with `prefix`; columns that have them are replaced.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    size = text_bytes(docs)
    names = [prefix + c for c in ("n_bytes", "n_removed", "n_spans", kept)]
    docs = docs.drop(*names)
    runs, pieces = max(parts, -(-2 * size // RUN_BYTES)), max(parts, -(-size // PIECE_BYTES))
    dealt = docs.withColumn(_RUN, F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int")).repartition(runs, _RUN)
    keys = dealt.groupBy(_RUN).applyInArrow(_announce(pieces), "segment int, run int, keys binary").repartition(pieces, "segment")
    shared = keys.groupBy("segment").applyInArrow(_shared_keys, "run int, segment int, bits binary")
    offered = dealt.groupBy(_RUN).cogroup(shared.groupBy("run")).applyInArrow(_offer(pieces, pieces), "target int, run int, kind int, blob binary").repartition(pieces, "target")
    spans = offered.groupBy("target").applyInArrow(_settle, "run int, spans binary")
    fields = [f for f in docs.schema.fields if not (kept == "kept_sha256" and f.name == "text")]
    kinds = [T.LongType()] * 3 + [T.BinaryType() if kept == "kept" else T.StringType()]
    schema = T.StructType([*fields, *map(T.StructField, names, kinds)])
    return dealt.groupBy(_RUN).cogroup(spans.groupBy("run")).applyInArrow(_cut(kept, prefix), schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs, "kept_sha256").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """`docs` with the text that stays, and its n_chars; a null text stays null."""
    kept = deduplicate(docs, "kept_text", "__").withColumn("text", F.when(F.col("text").isNotNull(), F.col("__kept_text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
