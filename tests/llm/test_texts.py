"""Operators on texts: brute force, round trips and the odd rows every operator must take."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, jaccard, linededup, lm, packing, queries, sharding, toxicity
from skein.llm.shingles import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MULTI, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "null id here now ok"), (5, "x " * 30_000), (6, "Ünïcödé 中文 😀 ​\x1c\x85 end"), (7, "one")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def clash(df):
    """Columns with names that operators use inside."""
    for c in ("hash", "key", "n", "shard", "token", "part", "score", "removed_lines", "component"):
        df = df.withColumn(c, F.lit("other"))
    return df


def words(rng, n, v=400):
    return [f"w{rng.randrange(v)}" for _ in range(n)]


def near_copies(rng, groups=6, size=12):
    rows, i = [], 0
    for _ in range(groups):
        base = words(rng, rng.randrange(30, 120))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def components(ids, links):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- 1 ---


def brute_jaccard(rows, percent=80):
    sets = [(i, set(shingle_set(t).tolist())) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return components({i for i, _ in sets}, links)


@pytest.mark.parametrize("seed,groups,size", [(1, 6, 12), (2, 2, 60), (3, 30, 3)])
def test_jaccard_equals_brute_force(spark, seed, groups, size, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 4)
    rng = random.Random(seed)
    rows = near_copies(rng, groups, size) + [(1000 + k, " ".join(words(rng, rng.randrange(1, 30)))) for k in range(40)]
    rows += [(2000, rows[0][1]), (2001, rows[3][1].upper())]
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, rows).repartition(5)).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_small_sets_and_edges(spark):
    a = "a b c d e f g h i j k l m n"  # 10 shingles
    rows = ODD + [(10, a), (11, a + " o p"), (12, a + " o p q"), (13, "one"), (14, "ONE")]
    out = clash(docs(spark, rows))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(out).collect()]
    assert len(got) == len(rows)
    want = brute_jaccard(rows)
    assert all(c == want[d] for d, _, c in got if d is not None)
    assert {c for d, _, c in got if d is None} == {None}
    assert {d: n for d, n, _ in got if d in (1, 2, 3, 4, 10, 11, 12)} == {1: 0, 2: 0, 3: 0, 4: 1, 10: 10, 11: 12, 12: 13}
    assert jaccard.join(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_of_repeated_ids_with_other_texts(spark, block, monkeypatch):
    """Many near copies of one base, ids with two texts each, in long lists and in blocks of one pivot."""
    rng = random.Random(31)
    base = words(rng, 60)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i // 2, " ".join(w)))
    monkeypatch.setattr(jaccard, "LONG_LIST", 4)
    same = jaccard._same_pivot
    monkeypatch.setattr(jaccard, "_same_pivot", lambda a, c, p: same(a, c, p, block))
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, rows), 80, 5).collect()}
    sets = [(i, set(jaccard.shingle_set(t).tolist())) for i, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    root = {i: i for i, _ in rows}
    while True:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert got == root and len(set(root.values())) > 1


def test_words_of_texts_longer_than_a_segment():
    rng = random.Random(32)
    text = " ".join(words(rng, 300_000)) + "\n" + "x" * (3 << 20) + " end"
    whole = jaccard.shingle_set(text)
    w = text.split()
    assert len(text) > 4 << 20
    from skein.llm import shingles

    each = {x: int(shingles.word_hashes(x)[0]) for x in set(w)}
    assert [each[x] for x in w] == shingles.word_hashes(text).tolist()
    assert len(whole) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def test_shingles_follow_the_definition():
    text = "The QUICK\tbrown\x0bfox ÄÖ\njumps\x85over"
    w = text.encode().lower().split()
    assert len(shingle_set(text)) == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    assert (shingle_set("A b") == shingle_set("a  B")).all() and len(shingle_set("a b")) == 1
    assert not set(shingle_set("a b").tolist()) & set(shingle_set("a b c").tolist())


def test_choose_matches_needs_no_more_than_the_overlap():
    for n in (1, 2, 5, 40, 400):
        for c in (np.ones(n), np.full(n, 1e6)):
            l = jaccard.choose_matches(c, n, 80, 0.0)
            assert 1 <= l <= max(1, jaccard._needed(n, 80))


# --- 4 ---


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(MULTI)


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(ranks, reference):
    enc, rng = bpe.Encoder(ranks, PATTERN), random.Random(4)
    dec = bpe.StreamDecoder(enc.transducer.tokens)
    parts = ["a", "é", "ß", "the", "ing", " ", "\n", "  ", "23", "　", "\x85", "😀", "中文", "'s", "_", "...", "ЖЖ", "=", "​", "<|endoftext|>"]
    vocabulary = list(ranks)
    for k in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(50))) if k % 2 else b"".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))).decode("utf8", "ignore")
        ids = enc.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert dec.feed(ids) + dec.finish() == t
    for t in ("a" * 5000, "=" * 3000, "ab" * 4000):
        assert enc.encode(t) == reference.encode_ordinary(t)


def test_bpe_forgets_and_goes_on(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    enc, rng = bpe.Encoder(ranks, PATTERN), random.Random(5)
    for _ in range(200):
        t = " ".join("".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 12))) for _ in range(20))
        assert enc.encode(t) == reference.encode_ordinary(t)


def test_decoder_takes_any_bytes():
    dec = bpe.StreamDecoder({i: bytes((i,)) for i in range(256)})
    text = "aé中😀"
    assert "".join(dec.feed([b]) for b in text.encode()) + dec.finish() == text
    assert dec.feed([0xC3]) + dec.finish() == "�"
    assert dec.feed([0xE4, 0x41, 0xFF]) + dec.finish() == "�A�"


def test_bpe_documents(spark, reference):
    got = bpe.encode_documents(clash(docs(spark, ODD)), MULTI, PATTERN)
    rows = got.collect()
    assert len(rows) == len(ODD)
    want = Counter((i, hashlib.sha256(np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = Counter((r.doc_id, r.text) for r in bpe.decode_ids(got, MULTI, chunk=7).collect())
    assert back == Counter((i, t or "") for i, t in ODD)
    assert bpe.encode_documents(docs(spark, []), MULTI, PATTERN).count() == 0


# --- 5 ---


def brute_scores(rows):
    texts = [(i, (t or "").lower().split()) for i, t in rows if i is not None]
    grams, ctx, uni, total = Counter(), Counter(), Counter(), 0
    for _, w in [(i, (t or "").lower().split()) for i, t in rows]:
        uni.update(w)
        total += len(w)
    for _, w in texts:
        grams.update(zip(w, w[1:]))
        ctx.update(w[:-1])
    out = defaultdict(float)
    for i, w in texts:
        own_g, own_c, own_u = Counter(zip(w, w[1:])), Counter(w[:-1]), Counter(w)
        for k, x in enumerate(w):
            back = np.log(max(uni[x] - own_u[x], 1)) - np.log(max(total - len(w), 1))
            if k and grams[w[k - 1], x] - own_g[w[k - 1], x] > 0:
                out[i] += np.log(grams[w[k - 1], x] - own_g[w[k - 1], x]) - np.log(ctx[w[k - 1]] - own_c[w[k - 1]])
            else:
                out[i] += back + (np.log(0.4) if k else 0)
        out[i] += 0
    return out


@pytest.mark.parametrize("hot", [0.5, 0.002])
def test_scores_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    monkeypatch.setattr(lm, "STEP_ROWS", 500)
    rng = random.Random(7)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 80), 60))) for i in range(60)] + [(100, None), (101, ""), (102, "solo"), (103, "same same same same"), (104, "same same same same")]
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm.score_documents(clash(docs(spark, rows)).repartition(3)).collect()}
    want = brute_scores(rows)
    assert {i: len((t or "").split()) for i, t in rows} == {i: n for i, (n, _) in got.items()}
    assert all(abs(got[i][1] - want[i]) < 1e-6 for i in want)
    assert lm.score_documents(docs(spark, [])).count() == 0


def test_scores_of_odd_rows(spark):
    got = lm.score_documents(docs(spark, [r for r in ODD if r[0] != 5])).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 6, 7}
    assert all(r.mean_log_score is None for r in got if r.n_words == 0)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    cols = {"DOC": rng.integers(-5, 5, 300), "V": np.sort(rng.integers(0, 2**63, 300).astype(np.uint64)), "n": rng.integers(0, 70_000, 300)}
    n_doc = (cols["DOC"] + 5) * 3
    out = lm.unpack(lm.pack(**cols, n_doc=n_doc))
    assert all((out[k] == v).all() for k, v in {**cols, "n_doc": n_doc}.items())


# --- 6 ---


def line(rng, n=12):
    return " ".join(words(rng, n, 10**6))


def test_passages_go_and_the_rest_stays(spark):
    rng = random.Random(8)
    passage = [line(rng, 20) for _ in range(4)]
    single = line(rng, 60)
    short = line(rng, 10)
    rows = [(i, "\n".join([short] + [line(rng) for _ in range(rng.randrange(1, 6))] + (passage if i % 3 == 0 else []) + ([single] if i % 4 == 1 else []) + [line(rng) for _ in range(2)])) for i in range(24)]
    rows += [(50, rows[5][1]), (51, "\n\n".join(passage)), (52, short)]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, rows).repartition(4)).collect()}
    for i, t in rows:
        if i >= 50:
            continue
        gone = set(passage if i % 3 == 0 and i > 0 else []) | ({single} if i % 4 == 1 and i > 1 else set())
        assert got[i].text.split("\n") == [x for x in t.split("\n") if x not in gone], i
    assert got[50].text == "" and got[50].removed_lines == len(rows[5][1].split("\n"))
    assert got[51].text == "" and got[52].text == short
    assert got[0].text == rows[0][1] and got[0].lang == "en"


def exact_dedup(rows, least=50):
    """Texts after every run of `least` words or more that any document of smaller id holds is cut."""
    held = [(i, linededup.lines_of(t)) for i, t in rows]
    out = {}
    for d, lines in held:
        gone = set()
        for e, other in held:
            for shift in range(-len(other), len(lines)) if e < d else ():
                run = []
                for x in range(len(lines) + 1):
                    if x < len(lines) and 0 <= x - shift < len(other) and lines[x] == other[x - shift]:
                        run.append(x)
                        continue
                    if sum(len(lines[y].split()) for y in run) >= least:
                        gone.update(run)
                    run = []
        out[d] = "\n".join(x for y, x in enumerate(lines) if y not in gone)
    return out


def test_a_passage_goes_though_its_lines_have_different_first_holders(spark):
    rng = random.Random(21)
    lines = [line(rng, 10) for _ in range(6)]
    rows = [(0, "\n".join(lines[:3])), (1, "\n".join(lines)), (2, "\n".join(["own", *lines]))]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: rows[1][1], 2: "own"}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_the_any_earlier_document_rule(spark, seed):
    rng = random.Random(30 + seed)
    pool = [line(rng, rng.choice([1, 3, 8, 10, 14, 25, 49, 50])) for _ in range(40)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(len(pool))
            text += pool[a : a + rng.randrange(1, 14)] + [line(rng, rng.randrange(1, 12))] * rng.randrange(2)
        rows.append((i, "\n".join(text)))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows).repartition(3)).collect()}
    want = exact_dedup(rows)
    assert got == want and sum(want[i] != t for i, t in rows) > 10


def test_line_dedup_of_odd_rows(spark):
    long = "\n".join("p q r s t u v w x y" for _ in range(8))
    rows = ODD + [(20, long), (20, long), (None, long), (21, long + "\n"), (22, "\n\n" + long)]
    out = linededup.dedup_lines(clash(docs(spark, rows))).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert [r.text for r in by[20]] == [long, long] and {r.text for r in by[None]} == {"null id here now ok", long}
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == "   \n\t "
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_chunks_do_not_depend_on_what_precedes():
    rng = random.Random(9)
    passage = [line(rng) for _ in range(40)]
    cut = lambda head: {h for h, i, n in linededup.line_chunks([*head, *passage]) if n > 2}
    a, b = cut([line(rng) for _ in range(3)]), cut([line(rng) for _ in range(8)])
    assert len(a & b) >= 3


# --- 7 ---


def test_segments_equal_the_definition():
    """Every maximal segment by the recursive definition: the best segment, then left and right of it."""

    def best(scores, a, b):
        top = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 0 and (top is None or s > top[0] + 1e-9):
                    top = s, i, j + 1
        if top is None:
            return []
        return best(scores, a, top[1]) + [top] + best(scores, top[2], b)

    rng = random.Random(10)
    for _ in range(200):
        scores = [rng.choice([-1.5, -0.3, -0.3, 0.7, 2.1]) for _ in range(rng.randrange(1, 25))]
        hits = [(i, s) for i, s in enumerate(scores) if s != -0.3]
        got = sorted((round(s, 6), a, b) for s, a, b in toxicity.maximal_segments(hits, -0.3))
        assert sorted(x[0] for x in got) == pytest.approx(sorted(x[0] for x in best(scores, 0, len(scores))))


def toxic_rows(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 120), 300)
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "scorn", "loath"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(11)
    rows, labels = toxic_rows(rng)
    lab = spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r for r in toxicity.score(clash(d), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i].score >= 0.7) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    hit = next(got[i] for i in held if i % 4 == 0 and got[i].passages)
    text = dict(rows)[hit.doc_id]
    assert any(w in text[hit.passages[0].start : hit.passages[0].end] for w in ("vile", "scorn", "loath"))
    kept = {r.doc_id for r in toxicity.reject(d, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = toxic_rows(random.Random(12), 200)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.fit(docs(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert a.scores == b.scores and a.weights == pytest.approx(b.weights)


def test_toxicity_of_odd_rows(spark):
    lab = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    d = docs(spark, ODD)
    model = toxicity.fit(d, lab)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score < 0.7 for r in out)
    assert toxicity.score(docs(spark, []), toxicity.fit(docs(spark, []), lab.limit(0))).count() == 0


# --- 8 ---


def test_sharding_law(spark):
    d = clash(docs(spark, [(i, f"text {i}") for i in range(4000)] + ODD))
    rows = sharding.shard_documents(d, 16).collect()
    assert len(rows) == 4000 + len(ODD)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert 150 < sum(r.shard == s for r in rows) < 360
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and 120 < sum(r.grown_shard == 16 for r in rows) < 360
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in by.values())
    text = {1: "", 2: "", 4: "one"}
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id is None} == {(len(b"null id here now ok") + 1, zlib.crc32(b"null id here now ok"))}
    assert all((r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in (text[r.doc_id], f"text {r.doc_id}")} for r in rows if r.doc_id in text)
    assert sharding.shard_documents(docs(spark, []), 16).count() == 0


def test_every_step_of_growth_moves_rows_into_the_new_shard_only(spark):
    d = spark.range(3000).withColumnRenamed("id", "doc_id")
    trees = [sharding.topology(n) for n in range(14, 21)]
    rows = d.select(*[sharding.shard_of(F.col("doc_id"), t).alias(f"s{i}") for i, t in enumerate(trees)]).collect()
    for i in range(2, len(trees) - 1):  # from the base of 16 on
        assert all(r[i] == r[i + 1] or r[i + 1] == 14 + i for r in rows)


def test_a_weight_moves_rows_inside_its_subtrees(spark):
    leaf = lambda s, w=1.0: sharding.Node(f"shard{s}", w, shard=s)
    rack = lambda n, a, b, w=1.0: sharding.Node(n, 2.0, (leaf(a, w), leaf(b)))
    tree = lambda w: sharding.Node("root", 4, (sharding.Node("r0", 2, (rack("r0a", 0, 1, w), rack("r0b", 2, 3))), sharding.Node("r1", 2, (rack("r1a", 4, 5), rack("r1b", 6, 7)))))
    d = spark.range(2000)
    rows = d.select(sharding.shard_of(F.col("id"), tree(1.0)).alias("a"), sharding.shard_of(F.col("id"), tree(3.0)).alias("b")).collect()
    assert all(r.a == r.b or (r.a, r.b) == (1, 0) for r in rows) and any(r.a != r.b for r in rows)


# --- 9 ---


def check_packing(spark, rows, capacity=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs(spark, rows), RANKS, PATTERN, capacity, with_ids=True).collect()
    want = Counter()
    for i, text in rows:
        want[i, np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces = defaultdict(list)
    for r in out:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for (i, ids), n in want.items():
        same = sorted(pieces[i, len(ids) // 4])
        assert b"".join(x for _, x in same[::n]) == ids
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    used = sum(n for b in bins.values() for _, n in b)
    return used, len(bins) * capacity


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(13)
    used, room = check_packing(spark, [(i, " ".join(words(rng, rng.randrange(1, 1500)))) for i in range(60)])
    assert room - used < max(0.02 * used, 2 * 2048)


def test_packing_of_odd_rows(spark):
    check_packing(spark, [r for r in ODD if r[0] is not None])
    assert packing.pack_documents(clash(docs(spark, ODD)), RANKS, PATTERN).filter("doc_id is null").count() >= 1
    assert packing.pack_documents(docs(spark, []), RANKS, PATTERN).count() == 0


def test_packing_matches_added_tokens_as_the_json_form_does(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x  {end}  y\n\n {end}\n", f"{end}don{end}'t 12{end}3", "<|endoftext|", f"<{end}>", "<|ENDOFTEXT|>", f"Ü {end}中文 \x85"]
    out = packing.pack_documents(docs(spark, list(enumerate(texts))), RANKS, PATTERN, with_ids=True).collect()
    got = {i: [x for r in sorted(out, key=lambda r: r.start) if r.doc_id == i for x in np.frombuffer(r.ids, "<u4").tolist()] for i in range(len(texts))}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, 1]


def test_piece_lengths():
    for n in range(0, 5000, 7):
        p = packing.piece_lengths(n, 2048)
        assert sum(p) == n and all(0 < x <= 2048 for x in p)


# --- queries ---


def test_queries_are_registered_once_each():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
