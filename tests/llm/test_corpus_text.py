"""Text operators against brute force, on awkward rows: nulls, empty and very long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import common, licenses, minhash, mixing, packing, sharding, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 120))) for _ in range(n // 3)]
    texts = list(base)
    for t in base:  # near copies and exact copies
        w = t.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts += [" ".join(w), t if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(40))]
    return texts + [None, "", "   \n\t", "one", "One", "a b c d e", "A  b\tc d e", "é" * 70 + " x" * 80, "long " * 30000]


# ---- 1: suffix dedup


def brute_repeats(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for key, text in order:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        opens = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((key, len(raw), int(gone.sum()), opens, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


KEY = lambda r: tuple((x is not None, x) for x in r)


def test_suffix_dedup_matches_brute_force(spark):
    texts = corpus()[:-1] + ["ab" * 400, "ab" * 150, "q" * 99, "z" * 100, "z" * 100, "long " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0] * 3), (None, "x" * 300), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(k, t, 7, 8) for k, t in rows], "doc_id long, text string, run int, n_bytes int")
    got = suffix_dedup.deduplicate(df, "kept_sha256").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute_repeats(rows), key=KEY)


def test_suffix_dedup_random_small_alphabets(spark):
    rng = random.Random(3)
    rows = []
    base = "".join(rng.choice("ab") for _ in range(700))
    for d in range(80):
        rows.append((d, "".join(base[(i := rng.randrange(600)) : i + rng.randrange(60, 200)] + rng.choice(["", "z", str(d)]) for _ in range(4))))
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), "kept_sha256").collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats(rows))


def test_repeated_windows_are_told_apart_by_their_bytes(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(400)) * 2
    run = suffix_dedup.Run([1], [text])
    windows = np.arange(len(text) - 99)
    seen, want = set(), []
    for p in windows:
        want.append(text[p : p + 100] in seen)
        seen.add(text[p : p + 100])
    assert run.repeated(windows).tolist() == want
    few = lambda self, at, length: np.array([self.data[p] % 2 for p in at], np.uint64)
    monkeypatch.setattr(suffix_dedup.Run, "hashes", few)  # nearly all hashes collide
    assert run.repeated(windows).tolist() == want and run.repeated(windows[:0]).tolist() == []


def test_suffix_dedup_of_many_pieces_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1 << 18)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 1 << 18)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    long, shared = noise(1_300_000), noise(3000)  # longer than a block
    rows = [(i, noise(500) + shared + noise(200)) for i in range(40)] + [(100, long), (101, long[:700_000] + noise(10) + shared + long[700_000:])]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), "kept_sha256").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rows))


def test_suffix_dedup_keeps_whole_characters_and_nulls(spark):
    whole = "".join(chr(0xC0 + i) for i in range(60))
    docs = frame(spark, [whole, "x" + whole, None, ""]).withColumn("run", suffix_dedup.F.lit("own")).withColumn("n_bytes", suffix_dedup.F.lit(-1))
    got = {r.doc_id: r for r in suffix_dedup.deduplicated_documents(docs).collect()}
    assert all(r.run == "own" and r.n_bytes == -1 for r in got.values())
    assert got[0].text == whole and got[1].text == "x" and got[2].text is None and got[3].text == "" and got[1].n_chars == 1


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string"), "kept_sha256").count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 7, 8])
def test_loser_tree_merges_and_knows_common_prefixes(k):
    rng = random.Random(k)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(rng.randint(0, 12))) for _ in range(k)]

    def coded(run):
        last = b""
        for s in run:
            yield s, suffix_dedup._common(last, s, 0), b"", (0, 0, 0), 0
            last = s

    out, last = [], b""
    for entry, shared in suffix_dedup.merged([coded(r) for r in runs]):
        if out:
            assert shared == suffix_dedup._common(last, entry[0], 0)
        last = entry[0]
        out.append(last)
    assert out == sorted(s for r in runs for s in r)


# ---- 2: mixing


def test_mixing_targets_counts_and_closeness(spark):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))) for _ in range(900)] + [None, "", " \t"]
    df = frame(spark, texts, ["s0", "s0", "s0", "s1", "s2", None, "s0"])
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = sum(sizes.values())
    capped: set = set()
    while True:  # reshare the excess by weight
        open_ = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        mine = [r for r in rows if r.source == s]
        want = 3 * sizes[s] if s in capped else share[s]
        assert mine[0].target == pytest.approx(want) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - want) <= max(0.01 * want, 60)
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in mine)
        tilt = {round(np.log(r.rate) / (1 + np.log(r.size)), 3) for r in mine if r.size > 20 and r.rate < 3}
        assert len(tilt) <= 2 and sum(r.rate * r.size for r in mine) == pytest.approx(want, rel=1e-5)
        assert all(abs(r.copies - r.rate) < 1 for r in mine)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=KEY) == sorted(map(tuple, rows), key=KEY)


def test_mixing_caps_and_copies(spark):
    df = frame(spark, ["w " * 10] * 30 + ["w " * 2] * 3, ["big"]).withColumn("source", mixing.F.when(mixing.F.col("doc_id") >= 30, "tiny").otherwise("big"))
    rows = mixing.mix(df).collect()
    assert {r.target for r in rows if r.source == "tiny"} == {18.0} and all(r.copies == 3 for r in rows if r.source == "tiny")
    docs = mixing.mixed_documents(df).collect()
    assert len(docs) == sum(r.copies for r in rows) and set(docs[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def brute_lambda(sizes, target):
    """Root of the gradient by bisection."""
    low, high = -20.0, np.log(3)
    x = 1 + np.log(np.array(sizes, float))
    for _ in range(200):
        at = (low + high) / 2
        low, high = (at, high) if (np.array(sizes) * np.minimum(3, np.exp(at * x))).sum() < target else (low, at)
    return at


def test_newton_finds_the_root_of_every_dual(spark):
    rng = random.Random(3)
    sizes = {s: [rng.choice([1, 2, 30, 500, 20000]) for _ in range(50)] for s in "abcdef"}
    share = dict(zip("abcdef", (0.01, 0.5, 0.999, 1.0, 1.7, 2.9), strict=True))
    counted = spark.createDataFrame([(s, n, sizes[s].count(n)) for s in sizes for n in set(sizes[s])], "source string, size long, n long")
    targets = spark.createDataFrame([(s, sum(sizes[s]), share[s] * sum(sizes[s])) for s in sizes] + [("none", 0, 0.0)], "source string, source_size long, target double")
    got = dict(map(tuple, mixing.balanced(counted, targets).collect()))
    assert set(got) == set(sizes)
    for s in sizes:
        assert got[s] == pytest.approx(brute_lambda(sizes[s], share[s] * sum(sizes[s])), abs=1e-8)


@pytest.mark.parametrize("folded", [20_000, 0])
def test_copies_are_chosen_in_order_until_none_fits(spark, monkeypatch, folded):
    """Passes alone, and passes with the fold, against one loop over the sorted documents."""
    monkeypatch.setattr(mixing, "FOLDED", folded)
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([3, 7, 50, 51, 900]), rng.choice([None, i // 2]), float(rng.randrange(1 << 48))) for i in range(400)]
    lacks = {"a": 5003, "b": 99, None: 1}
    asked = spark.createDataFrame(rows, "row long, source string, size long, key long, turn double")
    got = sorted(r.row for r in mixing._sampled(asked, spark.createDataFrame(list(lacks.items()), "source string, lack long"), 8).collect())
    want = []
    for source, lack in lacks.items():
        for row, _, size, _, _ in sorted((r for r in rows if r[1] == source), key=lambda r: (r[4], r[3] is not None, r[3] or 0, r[2], r[0])):
            if size <= lack:
                want.append(row)
                lack -= size
    assert got == sorted(want)


def test_mixing_rows_that_share_a_doc_id_and_clashing_columns(spark):
    rows = [(1, "w " * 10, "a"), (1, "w " * 3, "a"), (1, "w " * 3, "a"), (None, "w " * 4, "a"), (None, "w " * 4, "b"), (2, None, "b"), (2, "", "b"), (3, "w " * 200, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for column in ("row", "size", "copies", "target", "turn", "key"):
        docs = docs.withColumn(column, mixing.F.lit("own"))
    plan, mixed = mixing.mix(docs).collect(), mixing.mixed_documents(docs).collect()
    assert len(plan) == len(rows) and all(r.copies == 0 and r.rate == 0 for r in plan if r.size == 0)
    words = lambda s: sum(len(r.text.split()) for r in mixed if r.source == s)
    for source in "abc":
        assert words(source) == sum(r.taken for r in plan if r.source == source)
    assert all(r.row == r.size == r.key == "own" and r.text for r in mixed)


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix(frame(spark, [None, "", " "])).collect()
    assert [r.taken for r in rows] == [0, 0, 0] and [r.copies for r in rows] == [0, 0, 0]
    assert mixing.mixed_documents(frame(spark, [None, "", " "])).count() == 0


# ---- 5: packing


def brute_padding(lengths, k):
    """Least padding over all choices of boundaries, by exhaustive search."""
    from itertools import combinations

    tops = sorted(set(lengths))
    best = None
    for n in range(1, min(k, len(tops)) + 1):
        for inner in combinations(tops[:-1], n - 1):
            ends = [*inner, tops[-1]]
            cost = sum(min(e for e in ends if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randint(1, 14) for _ in range(rng.randint(1, 30))]
        tops = sorted(set(lengths))
        ends = packing.optimal_boundaries([(t, lengths.count(t), t * lengths.count(t)) for t in tops], 3)
        assert len(ends) <= 3 and ends[-1] == tops[-1]
        assert sum(min(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths, 3)


def test_batches_hold_the_budget(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.randint(1, 80), rng.randint(1000, 9000)]), i % 3) for i in range(400)] + [(400, None, 0), (401, 0, 0), (5, 7, 1), (None, 9, 1), (402, 50000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, length long, bucket int")
    got = packing.pack(df, buckets=6, token_budget=10000).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        if r.length is None or r.length < 1:
            assert r.bucket is None and r.batch is None
            continue
        assert r.length <= r.pad_to
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, _), members in batches.items():
        assert len(members) == 1 or members[0].pad_to * len(members) <= 10000
        assert sorted(m.slot for m in members) == list(range(len(members)))
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
        full = [len(m) for (b, n), m in batches.items() if b == bucket and n < numbers[-1]]
        assert len(set(full)) <= 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


def test_histogram_cells_never_cut_a_length(spark):
    got = spark.range(1, 5000).select("id", packing.cell_of(packing.F.col("id")).alias("c")).collect()
    assert all(r.c == r.id for r in got if r.id < 1024)
    assert all(r.c <= r.id < r.c * (1 + 1 / 128) + 1 for r in got)


# ---- 7: sharding


def test_rendezvous_moves_rows_only_to_the_new_shard(spark):
    df = spark.createDataFrame([(i, "x", 5) for i in range(3000)] + [(None, "n", 5), (7, "again", 5)], "doc_id long, text string, slot int")
    got = sharding.shard(df, [1.0] * 8).collect()
    assert len(got) == 3002
    nine = {r.doc_id: r.shard for r in sharding.shard(df, [1.0] * 9).collect()}
    for r in got:
        assert r.grown_shard in (r.shard, 8) and nine[r.doc_id] == r.grown_shard
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 280 < len(slots) < 480
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_slots_of_rows_that_share_a_key_agree_between_runs(spark):
    df = spark.createDataFrame([(i % 3 or None, str(i)) for i in range(60)], "doc_id long, text string")
    runs = [sorted(map(tuple, sharding.shard(df.repartition(n), [1.0] * 2, then=("text",)).collect()), key=repr) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_rendezvous_weights(spark):
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    counts = dict(sharding.shard(df, [1.0, 2.0, 3.0]).groupBy("shard").count().collect())
    assert [round(counts[s] / 1000) for s in range(3)] == [1, 2, 3]
    with pytest.raises(ValueError):
        sharding.rendezvous(sharding.F.col("x"), [1.0, 0.0])
    assert sharding.shard(spark.createDataFrame([], "doc_id long"), [1.0]).count() == 0


# ---- 8: toxicity


def model_of(words):
    counts = np.ones((28, 28, 28))
    for w in words:
        codes = [0, 0, *[toxicity.code(c) for c in w], 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[0 if b == 0 else a, b, c] += 50
    return np.log(counts / counts.sum(2, keepdims=True))


@pytest.mark.parametrize("hidden", ["m0r0n", "moooron", "m.o.r.o.n", "m-o-r-o-n", "m0rrr0n", "MORON".lower()])
def test_hidden_words_are_restored(hidden):
    reader = toxicity.Reader(model_of(["moron", "idiot", "the", "and"]))
    assert "moron" in reader.words(f"so {hidden}, there")[0]


def test_spaced_words_are_restored():
    reader = toxicity.Reader(model_of(["moron", "idiot", "the", "and"]))
    assert "idiot" in reader.words("you 1 d 1 0 t there")[0]
    assert reader.words(None) == (set(), 0) and reader.words("") == (set(), 0)
    assert reader.words("plain words 2024 55")[0] >= {"plain", "words"}


@pytest.mark.parametrize("text,word", [("a s t u p i d", "stupid"), ("y o u s t u p i d", "stupid"), ("m o r o n. s h i t.", "shit"), ("s h i t..........", "shit"), ("m.o.r.o.n.s.t.u.p.i.d", "stupid"), ("y o u " * 100 + "s t u p 1 d", "stupid"), ("y o u m 0 r o n", "moron")])
def test_spaced_runs_have_word_breaks(text, word):
    reader = toxicity.Reader(model_of(["moron", "stupid", "shit", "you", "a"]))
    assert word in reader.words(text)[0]


@pytest.mark.parametrize("token,word", [("!diot", "idiot"), ("!d!ot", "idiot"), ("¡diot,", "idiot"), ("(lown", "clown"), ("idiot!", "idiot"), ("(idiot)", "idiot"), ("idiooot!!", "idiot")])
def test_signs_at_the_edges_may_be_letters(token, word):
    assert word in toxicity.Reader(model_of(["moron", "idiot", "clown"])).words(f"so {token} there")[0]


@pytest.mark.parametrize("token", [".".join("youareamoronyouidiotyou"), "i" * 60 + "diot", "1d10" + "o" * 60 + "t", "idiot" + "(1)" * 20, "xyz" * 20 + "1d10t"])
def test_long_tokens_are_decoded(token):
    found = toxicity.Reader(model_of(["moron", "idiot", "you", "are", "a", "xyz"])).words(token)[0]
    assert len(token) > 40 and any("idiot" in w for w in found), found


@pytest.mark.parametrize(("token", "word"), [("iidiioot", "idiot"), ("moorron", "moron"), ("m0r0n" * 9, "moron"), ("idiiot", "idiot"), ("book", "book")])
def test_doubled_letters_are_decoded(token, word):
    assert word in toxicity.Reader(model_of(["moron", "idiot", "book"])).words(f"so {token} there")[0]


@pytest.mark.parametrize("breaks", [False, True])
def test_settling_changes_no_reading(monkeypatch, breaks):
    model, rng = model_of(["moron", "idiot", "you"]), random.Random(6)
    words = ["".join(rng.choice("m0r1d!ootyu(") for _ in range(300)) for _ in range(5)]
    settled = [toxicity.decode(w, model, breaks) for w in words]
    monkeypatch.setattr(toxicity, "_SETTLE", 10**6)
    assert settled == [toxicity.decode(w, model, breaks) for w in words]


def brute_decode(word, model):
    best = None

    def walk(options, score, text, a, b):
        nonlocal best
        if not options:
            total = score + model[a, b, 0]
            best = max(best, (total, text)) if best else (total, text)
            return
        for letters, cost in options[0]:
            x, y, s = a, b, score - cost
            for letter in letters:
                z = toxicity.code(letter)
                s += model[x, y, z]
                x, y = y, z
            walk(options[1:], s, text + letters, x, y)

    walk(toxicity.lattice(word), 0.0, "", 0, 0)
    return best[1]


def test_viterbi_finds_the_best_path():
    model = model_of(["moron", "clown", "trash", "idiot", "stupid", "worthless"])
    for word in ["m0r0n", "cl0wn", "7r4sh", "1d10t", "s7up1d", "w0r7hl355", "tr4aaash", "!d!ot"]:
        assert toxicity.decode(word, model) == brute_decode(word, model)


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(9)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "su", "ti", "ve"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [word() for _ in range(60)]
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(60), rng.choice(["grobble", "snizzle", "gr0bble", "sn1zzle"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "grobble"), (903, "grobble " * 40000), (902, "grobble")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", toxicity.F.lit("old"))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = toxicity.training_labels(labelled)
    model = toxicity.train(docs, learned)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    known = {r.doc_id for r in learned.collect()}
    held = [i for i in range(900) if i not in known]
    assert len(held) > 200
    right = sum((got[i] >= toxicity.CUTOFF) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.98
    assert got[900] == got[901] < 0.3 and got[902] >= 0.7 and got[903] >= 0.7


def brute_scores(rows, labels, letters):
    """Scores from plain counts over all labelled documents: every feature is tried, none is filtered beforehand."""
    reader, seen = toxicity.Reader(letters), []
    for key, text in rows:
        if key in labels:
            digest = hashlib.md5(str(key).encode()).hexdigest()
            seen.append((reader.words(text), labels[key], int(digest[31], 16) % 2))
    has = {(h, y): sum(1 for _, label, half in seen if (half, label) == (h, y)) for h in (0, 1) for y in (0, 1)}
    counts = {}
    for (words, _), label, half in seen:
        for f in {f for w in words for f in [w, *[w[:k] + "~" for k in (4, 5) if len(w) > k]]}:
            counts.setdefault(f, {}).setdefault((half, label), 0)
            counts[f][half, label] += 1
    odds = lambda c, hs: toxicity._log_odds(*(sum(c.get((h, y), 0) for h in hs) for y in (1, 0)), *(sum(has[h, y] for h in hs) for y in (1, 0)))
    weights = [{f: w for f, c in counts.items() if (w := odds(c, hs))} for hs in ((0,), (1,), (0, 1))]
    x = np.array([toxicity.evidence(words, n, weights[1 - half]) for (words, n), _, half in seen])
    fit = toxicity.logistic(x, np.array([label for _, label, _ in seen], float))
    z = [fit[0] + np.dot(fit[1:], toxicity.evidence(*reader.words(text), weights[2])) for _, text in rows]
    return [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in z]


def test_scores_match_brute_force(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], {}
    for i in range(300):
        toxic = i % 4 == 0
        text = rng.choices(words, k=30) + (rng.choices(["grobble", "gr0bble", "snizz", "s n i z z", "snizzz"], k=2) if toxic else [])
        rows.append((i, " ".join(text)))
        if i % 3:
            labels[i] = int(toxic)
    rows += [(300, None), (301, ""), (302, "x" * 5000), (None, "grobble")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    letters = toxicity.character_model(docs)
    table = spark.createDataFrame([(k, 0, v) for k, v in labels.items()] + [(9999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table, letters)
    got = {(r.doc_id, r.text): r.toxicity for r in toxicity.score(docs, model).collect()}
    for row, want in zip(rows, brute_scores(rows, labels, letters), strict=True):
        assert got[row] == pytest.approx(want, abs=1e-9)


def test_labels_without_a_document_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(160)], "doc_id long, text string")
    table = spark.createDataFrame([(i, 0, i % 2) for i in range(4000)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table, train_rows=160)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert min(got[i] for i in range(1, 160, 2)) > 0.7 > 0.3 > max(got[i] for i in range(0, 160, 2))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [round(r.toxicity, 6) for r in toxicity.score(docs, model).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.limit(0), model).count() == 0


# ---- 9: near duplicates


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                if rows[a][0] > rows[b][0]:
                    a, b = b, a
                label[b] = a
    return [(k, len(s), rows[root(i)][0], rows[root(i)][0] == k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(corpus(seed=11, n=150)))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    for i in range(60):  # a dense group whose members differ in one place each, and a chain
        w = list(base)
        w[rng.randrange(90)] = f"v{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 110))) for i in range(12)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == sorted(brute_components(rows))


def test_near_duplicates_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b  c d E f"), (None, "a b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=KEY)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True)], key=KEY)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def test_words_that_polynomial_hashes_confuse_are_not_linked(spark):
    rows = []
    for k, n in enumerate((512, 1024, 2048, 4096)):
        word = "".join(thue_morse(n))
        rows += [(10 * k, word), (10 * k + 1, word.translate(str.maketrans("ab", "ba"))), (10 * k + 2, f"x y z {word} w"), (10 * k + 3, f"x y z {word.translate(str.maketrans('ab', 'ba'))} w")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(i, 1, i, True) for i, _ in rows]


@pytest.mark.parametrize("vocabulary", [3, 60, 9000])
def test_shingle_numbers_are_equal_for_equal_words_alone(vocabulary):
    rng = random.Random(vocabulary)
    for _ in range(20):
        texts = [[rng.randrange(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 300]))] for _ in range(3)]
        texts.append(texts[2][1:-1])
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else {tuple(t)} if t else set() for t in texts]
        for radix in (vocabulary + 1, 1 << 20, 1 << 31):  # digits that fit and digits that do not
            numbers = minhash.shingle_numbers([np.array(t, np.int64) + 1 for t in texts], radix)
            assert [len(np.unique(n)) for n in numbers] == [len(s) for s in sets]
            assert len(np.intersect1d(numbers[2], numbers[3])) == len(sets[2] & sets[3])
        words = [b"%d" % w for w in texts[2]]
        assert len(minhash.shingle_hashes(words)) == len(sets[2])


@pytest.mark.parametrize("radix", [minhash.RADIX, 10])
def test_confirmation_is_exact(monkeypatch, radix):
    monkeypatch.setattr(minhash, "RADIX", radix)
    rng = random.Random(4)
    for _ in range(200):
        a = [b"%d" % rng.randrange(40) for _ in range(rng.choice([1, 4, 30, 60]))]
        b = list(a)
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = b"%d" % rng.randrange(45)
        leader = minhash.Leader()
        leader.add([b"other", b"text"])
        leader.add(a)
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in (a, b))
        assert leader.near(b) == (100 * len(s & t) >= 85 * len(s | t))


def test_hot_leaders_and_tiles_lose_no_link(spark, monkeypatch):
    """Every leader is salted and every bucket of several components is cut into tiles."""
    monkeypatch.setattr(minhash, "FAN", 4)
    monkeypatch.setattr(minhash, "SPREAD", 8)
    monkeypatch.setattr(minhash, "TILE", 3)
    rng = random.Random(6)
    rows, base = [(0, " ".join(f"w{i}" for i in range(95)))], [f"w{i}" for i in range(90)]
    for i in range(1, 80):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(90)] = f"v{i % 7}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute_components(rows))


def test_a_bucket_of_near_texts_gives_a_forest():
    """Of n texts within the distance n - 1 pairs come out, not all; those of one component meet nobody of their own."""
    rng = np.random.default_rng(3)
    one = rng.integers(0, 256, minhash.SYMBOLS, np.uint8)
    rows = []
    for i in range(200):
        sig = one.copy()
        sig[minhash.WIDTH + rng.integers(0, minhash.INDEXED - minhash.WIDTH)] ^= 1  # the first chunk is whole
        rows.append((0, 0, 0, 0, 1000 + i if i % 4 else 1000, 1000 + i, sig.tobytes()))
    batch = pa.RecordBatch.from_pylist([dict(zip(["key", "i", "j", "block", "comp", "rep", "sig"], r, strict=True)) for r in rows])
    pairs = [p for b in minhash._cross([batch]) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(pairs) == 199 and {x for p in pairs for x in p} == {r[5] for r in rows}


@pytest.mark.parametrize("block", [4, 256])
def test_clusters_lose_no_link(spark, monkeypatch, block):
    """Texts near their neighbours only, and many at the threshold, without a leader near all; ids with several texts and repeated rows among them."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "TILE", 5)
    rng = random.Random(17)
    rows, base = [], [f"w{i}" for i in range(100)]
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(100)] = f"v{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(500 - i, " ".join(chain[5 * i : 5 * i + 130])) for i in range(40)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))
    more = [*rows, (7, rows[100][1]), rows[3], rows[3], (498, "some other words here in a row")]
    found = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    label = {k: c for k, _, c, _ in brute_components(rows)}
    joined = {label[7], label[rows[100][0]]}
    assert found == {(k, min(joined) if c in joined else c) for k, c in label.items()}


@pytest.mark.parametrize("bits", [common.SIFT_BITS, 1 << 15])
def test_sifting_loses_no_partner(spark, monkeypatch, bits):
    """Every row with a partner passes, each row passes on one side only, and a filter that is not full holds most others back."""
    monkeypatch.setattr(common, "SIFT_BITS", bits)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(-3000, 9000)] + [(None, "n"), (7, "again")], "id long, text string")
    for wanted in ([], [(None,)], [(i,) for i in range(0, 9000, 7)] + [(-1,), (-1,), (None,), (1 << 60,)]):
        ids = spark.createDataFrame(wanted, "other long")
        through = [tuple(r) for r in common.sift(rows, "id", ids).collect()]
        held = [tuple(r) for r in common.sift(rows, "id", ids, absent=True).collect()]
        known = {w for (w,) in wanted if w is not None}
        assert sorted(map(repr, through + held)) == sorted(repr(tuple(r)) for r in rows.collect())
        assert not [r for r in held if r[0] in known] and (None, "n") in held
        assert len([r for r in through if r[0] not in known]) < 0.1 * 12000
    assert (7, "again") in through and (7, "t7") in through


def test_rows_that_share_a_doc_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(70))
    rows = [(1, a), (1, b), (5, a + " x"), (6, b + " x"), (7, a)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 56, 1, True), (1, 66, 1, True), (5, 57, 1, False), (6, 67, 1, False), (7, 56, 1, False)]


def test_index_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 256, minhash.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(minhash.INDEXED, minhash.DISTANCE, replace=False)
        b[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
        batch = minhash.pa.RecordBatch.from_arrays([minhash.pa.array([1, 2]), minhash.pa.array([a.tobytes(), b.tobytes()])], ["rep", "sig"])
        keys = next(minhash._keys([batch])).column(0).to_numpy().reshape(2, -1)
        assert set(keys[0]) & set(keys[1])


# ---- 10: licences


def test_license_scan_matches_brute_force(spark):
    texts = corpus(seed=2) + [
        "Released under the MIT License. Under the mit-license, cc-by-nc!", "APACHE license, version 2.0 or cc BY nc", "under the mit licenseé", "xunder the mit license",
        "under the mit license under the mit license", "under THE\nMIT\tlicense x", "the word under the mit license", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0",
    ]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(texts[r.doc_id] or ""))
        at = sorted((i, p) for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        want = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({phrases[p] for _, p in at})))
        assert tuple(r)[1:6] == want, texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_licence(text):
    """labels and score by plain search and a recursive reading of expressions."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    has = lambda phrase: any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))
    rules = licenses.RULES
    labels = {label for phrase, label in {**rules.notices, **licenses.BASE_PHRASES}.items() if has(phrase)}
    scores = [rules.score(x) for x in labels]
    for line in re.findall(r"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)", text or ""):
        tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*", line)

        def reading(level):
            if level == 3:
                token = tokens.pop(0)
                if token == "(":
                    value = reading(0)
                    tokens.pop(0)
                    return value
                name = rules.label(token)
                labels.add(name)
                return rules.score(name)
            if level == 2:
                value = reading(3)
                while tokens and tokens[0].lower() == "with":
                    del tokens[:2]
                    value = (value + 1) / 2
                return value
            value = reading(level + 1)
            while tokens and tokens[0].lower() == ("or", "and")[level]:
                tokens.pop(0)
                value = (max, min)[level](value, reading(level + 1))
            return value

        scores.append(reading(0))
    if not labels and has("all rights reserved"):
        labels, scores = {"proprietary"}, [0.05]
    return ",".join(sorted(labels)), min(scores, default=0.0)


def test_license_labels_and_scores_match_brute_force(spark):
    rng = random.Random(3)

    def expression(depth=0):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return rng.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "CC-BY-NC-SA-4.0", "BSD-3-Clause", "AGPL-3.0-or-later", "X-Unheard"]) + rng.choice(["", "", " WITH Some-exception"])
        if kind < 0.6:
            return f"({expression(depth + 1)})"
        return f"{expression(depth + 1)} {rng.choice(['OR', 'AND', 'or'])} {expression(depth + 1)}"

    pieces = [*licenses.RULES.notices, *licenses.BASE_PHRASES, "All rights reserved.", "prose of no kind", "under the", "MIT license"]
    texts = [None, "", "cc by nc " * 5000, "All Rights Reserved", "Redistribution and use in source and binary forms. All rights reserved"]
    texts += [" ".join(rng.choice([str.upper, str])(rng.choice(pieces)) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts += [f"{rng.choice(pieces)}\n// SPDX-License-Identifier: {expression()}\nSPDX-License-Identifier: {expression()}\n" for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by nc"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    got = sorted(((r.doc_id, r.labels, round(r.score, 9)) for r in licenses.scan(df).collect()), key=KEY)
    assert got == sorted(((i, brute_licence(t)[0], round(brute_licence(t)[1], 9)) for i, t in rows), key=KEY)


def test_license_rules_can_be_a_table(spark):
    table = spark.createDataFrame([("notice", "Own Terms apply", "own", None), ("label", "own", None, 0.7), ("identifier", "OT-1", "own", None)], "kind string, key string, label string, permissive double")
    rules = licenses.rules_of(table)
    docs = spark.createDataFrame([(1, "own-terms APPLY"), (2, "SPDX-License-Identifier: OT-1.5"), (3, "under the mit license")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, rules).collect()}
    assert got == {1: ("own", 0.7), 2: ("own", 0.7), 3: ("mit", licenses.UNKNOWN)}


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("MIT */ AND GPL-2.0", ["mit"], 1.0),
        ("MIT", ["mit"], 1.0),
        ("MIT OR GPL-2.0-only", ["mit", "gpl"], 1.0),
        ("MIT AND GPL-2.0-only", ["mit", "gpl"], 0.3),
        ("MIT OR GPL-2.0 AND AGPL-3.0", ["mit", "gpl", "agpl"], 1.0),
        ("(MIT OR GPL-2.0) AND AGPL-3.0", ["mit", "gpl", "agpl"], 0.2),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl"], 0.65),
        ("GPL-2.0 WITH x OR MIT", ["gpl", "mit"], 1.0),
        ("Apache-2.0 the rest is prose", ["apache-2"], 1.0),
        ("", [], None),
        ("AND MIT", [], None),
        ("MIT OR", ["mit"], 1.0),
        ("((MIT", ["mit"], 1.0),
        ("CC-BY-NC-4.0", ["cc-by-nc"], 0.2),
        ("X-Own", ["x-own"], 0.1),
    ],
)
def test_license_expressions(text, labels, score):
    assert licenses.evaluate(text) == (labels, score)
