"""Operators on vectors and pages, and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ann, neardup, warc

VECS = "vec_id long, embedding array<float>, label int"


def vecs(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECS)


ODD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, []), (906, [1.0, 2.0, 3.0]), (907, [2.0, 4.0, 6.0])]


def cloud(rng, n, dim=16):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("cell,block", [(2048, 4096), (2048, 20), (16, 4096), (16, 10)])
def test_near_duplicates_equal_brute_force(spark, cell, block):
    rng = np.random.default_rng(1)
    x = cloud(rng, 150)
    x = np.concatenate([x, x[:40] + 0.03 * rng.standard_normal((40, 16)), x[:1] + 0.02 * rng.standard_normal((60, 16)), x[5:8] * 7, np.repeat(x[9:11], 30, axis=0)])
    rows = [(i, v) for i, v in enumerate(x)] + ODD + [(3, x[3]), (None, x[0])]
    d = vecs(spark, rows).withColumn("h", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("cells", F.lit(2)).withColumn("dim", F.lit(3))
    got = {r.vec_id: r for r in neardup.near_duplicates(d, 0.95, recall=0.99999, cell_rows=cell, block_rows=block).collect()}
    f = np.float32(x).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.where(link, comp[None, :], len(x)).min(axis=1)
        new = np.minimum(comp, new)
        if (new == comp).all():
            break
        comp = new
    assert len(got) == len(x) + len(ODD)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert [got[i].n_links for i in range(900, 906)] == [0] * 6 and got[906].n_links == 1 and got[907].component_id == 906


def test_calibrated_count_keeps_the_recall():
    rng, delta = np.random.default_rng(2), np.sqrt(0.1)
    least = neardup.threshold_count(neardup.PROJECTIONS, neardup.WINDOW, 0.9999)
    a = neardup.directions(64, neardup.PROJECTIONS)
    d = rng.standard_normal((4000, 64))
    d *= delta / np.linalg.norm(d, axis=1, keepdims=True)
    hits = (np.abs(d @ a) <= neardup.WINDOW * delta).sum(axis=1)
    assert (hits >= least).mean() > 0.995


def test_recall_at_the_threshold_over_many_vectors(spark):
    """Pairs planted at a cosine just over 0.95 among 50,000 vectors, in cells of about 200."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = cloud(rng, 50_000, 64)
    w = rng.standard_normal((4000, 64))
    w -= np.einsum("ij,ij->i", w, x[:4000])[:, None] * x[:4000]
    x[4000:8000] = 0.9501 * x[:4000] + np.sqrt(1 - 0.9501**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    t = pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float64()))})
    got = neardup.near_duplicates(spark.createDataFrame(t), 0.95, cell_rows=256).filter("n_links > 0").collect()
    assert all(r.n_links == 1 and r.component_id == r.vec_id % 4000 for r in got)
    assert len(got) >= 0.998 * 8000


def test_no_vectors(spark):
    assert neardup.near_duplicates(vecs(spark, [])).count() == 0
    assert neardup.near_duplicates(vecs(spark, ODD[:6])).filter("n_links > 0").count() == 0
    assert ann.search(vecs(spark, [])).count() == 0


def test_ann_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = cloud(rng, 3000)
    x[1500:1600] = x[0] + 0.01 * rng.standard_normal((100, 16))
    rows = [(i, v) for i, v in enumerate(x)] + ODD[:6] + [(None, x[0])]
    got = ann.search(vecs(spark, rows).withColumn("list", F.lit(1)).withColumn("rank", F.lit("x"))).collect()
    f = np.float32(x).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        best = set(np.lexsort((np.arange(3000), -s))[:5])
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [k for k, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in mine)
        assert [(-c, v) for _, v, c in mine] == sorted((-c, v) for _, v, c in mine)
        hit += len(best & {v for _, v, _ in mine})
    assert hit >= 0.9 * 5 * 60


def test_ann_recall_on_more_rows_than_the_index_is_fitted_on(spark):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = np.float32(cloud(rng, 24_000, 32))
    t = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 32).cast(pa.list_(pa.float32()))})
    got = ann.search(spark.createDataFrame(t), fit_rows=6000, query_every=100).collect()
    assert len(got) == 240 * 5
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u[::100] @ u.T
    s[np.arange(240), np.arange(0, len(x), 100)] = -2
    best = [set(row) for row in np.argpartition(-s, 5, axis=1)[:, :5]]
    assert sum(r.vec_id in best[r.query_id // 100] for r in got) >= 0.9 * len(got)


def test_ann_probes_few_of_many_balanced_lists():
    rng = np.random.default_rng(9)
    x = np.float32(cloud(rng, 20_000, 48))
    index = ann.Index(x, 1250, 5, 0.95, 4, 1.5, 8)
    sizes = np.bincount(index.post(x)[1], minlength=len(index.groups))
    assert 1000 <= len(sizes) <= 2500 and sizes.max() <= 12 * sizes.mean()
    assert len(index.probe(x[:200])[0]) <= 0.1 * 200 * len(sizes)


def test_ann_with_copies_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(10)
    x = cloud(rng, 300)
    x[100:200] = x[100]
    rows = [(i, v) for i, v in enumerate(x)] + [(3, x[3]), (3, x[4])]
    d = vecs(spark, rows).withColumn("lists", F.lit(1)).withColumn("first", F.lit(1)).withColumn("h", F.lit("x")).withColumn("dim", F.lit(0)).withColumn("grp", F.lit(0))
    got = ann.search(d).collect()
    of = lambda q: [(r.vec_id, round(r.score, 12)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
    assert of(100) == [(i, 1.0) for i in range(101, 106)]
    assert of(150) == [(i, 1.0) for i in range(100, 105)]
    assert sorted({r.query_id for r in got}) == list(range(0, 300, 50)) and len(got) == 30


def test_ann_with_few_candidates_and_ties(spark):
    rows = [(0, [1, 0]), (1, [2, 0]), (2, [3, 0]), (50, [0, 1])]
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(vecs(spark, rows)).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert ann.search(vecs(spark, [(0, [1, 0])])).count() == 0


def test_graph_search_finds_all_lists_in_the_ratio():
    rng = np.random.default_rng(4)
    c = cloud(rng, 300)
    g = ann.CentroidGraph(c)
    found = want = 0
    for q in cloud(rng, 50):
        d = np.sqrt(2 - 2 * c @ q)
        near = set(np.nonzero(d <= 1.2 * d.min())[0])
        found += len(near & set(g.search(q, 1.2, 1)))
        want += len(near)
    assert found >= 0.97 * want


PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (1 + i % 3)) for i in range(60)]
    rows += [(100, None, None), (101, "http://x\r\ny", ""), (102, "u", "é中" * 50_000), (103, "u", "a\r\n\r\nWARC/1.1\r\n"), (104, "u", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("bundle", F.lit(2))
    out = f"file://{tmp_path}/w"
    index = warc.write_bundles(pages, out, frame_bytes=2000, bundle_bytes=3000)
    got = {r.page_id: r for r in warc.read_bundles(spark, out, index, payloads=True).collect()}
    by = {}
    for i, _, h in rows:
        by[(h or "").encode()] = max(i, by.get((h or "").encode(), -1))
    assert len(got) == len(rows)
    for i, _, h in rows:
        body = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if by[body] == i else ("revisit", by[body]))
        assert r.payload == (body if by[body] == i else None)
    for r in index.collect():
        head, block = warc.read_record(out, r.bundle, r.frame_offset, r.frame_size, r.offset, r.length)
        assert head["warc-record-id"] == r.record_id and head["warc-type"] == r.record_type


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    rows = [(i, "u", f"page {i}" * 100) for i in range(20)]
    out = f"file://{tmp_path}/w"
    warc.write_bundles(spark.createDataFrame(rows, PAGES).coalesce(1), out, frame_bytes=3000)
    n = 0
    for f in (tmp_path / "w").glob("*.zst"):
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True).read()
        n += len(list(warc.parse_records(data)))
        table = warc.read_seek_table(io.BytesIO(f.read_bytes()), f.stat().st_size)
        assert sum(p for _, _, p in table) == len(data)
    assert n == 20


def test_archive_of_a_hot_payload_is_read_by_many_tasks(spark, tmp_path):
    rows = [(i, "u", "same" * 50 if i % 2 else f"page {i} " * 30) for i in range(2000)]
    out = f"file://{tmp_path}/w"
    index = warc.write_bundles(spark.createDataFrame(rows, PAGES).repartition(6), out, frame_bytes=4000)
    read = warc.read_bundles(spark, out, index)
    assert read.rdd.getNumPartitions() == index.select("bundle").distinct().count() > 1
    got = {r.page_id: r for r in read.collect()}
    assert len(got) == 2000
    assert all((r.record_type, r.refers_to) == (("revisit", 1999) if i % 2 and i < 1999 else ("response", None)) for i, r in got.items())


def test_a_repeated_id_with_several_payloads(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (3, "u", "b"), (3, "u", "b")]
    out = f"file://{tmp_path}/w"
    got = warc.read_bundles(spark, out, warc.write_bundles(spark.createDataFrame(rows, PAGES), out)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [
        (1, "revisit", 2), (1, "revisit", 3), (2, "response", 0), (3, "response", 0), (3, "response", 0)]


def test_archive_of_odd_rows(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "u", "b"), (None, None, None)]
    out = f"file://{tmp_path}/w"
    index = warc.write_bundles(spark.createDataFrame(rows, PAGES), out, min_bytes=2)
    got = warc.read_bundles(spark, out, index).collect()
    assert len(got) == 5 and {r.record_type for r in got} == {"response"}
    empty = f"file://{tmp_path}/e"
    assert warc.read_bundles(spark, empty, warc.write_bundles(spark.createDataFrame([], PAGES), empty)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Planted cases through the stages: what is toxic, repeated or a near copy goes, the clean rest stays."""
    import random

    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"
    clean = {i: "\n".join(" ".join(word() for _ in range(15)) for _ in range(6)) for i in range(300)}
    texts, toxic = dict(clean), {}
    for i in range(300, 420):
        w = [word() for _ in range(80)]
        for _ in range(5):
            w[rng.randrange(80)] = rng.choice(["vile", "scorn", "loath"])
        texts[i], toxic[i] = " ".join(w), 1
    base = [word() for _ in range(200)]
    for i in range(500, 510):
        w = list(base)
        w[(i - 500) * 17 + 3] = f"edit{i}"
        texts[i] = " ".join(w)
    passage = "\n".join(" ".join(word() for _ in range(30)) for _ in range(3))
    for i in (600, 601, 602):
        texts[i] = f"{clean[i - 600]} more{i}\n{passage}\n" + " ".join(word() for _ in range(40))
        texts[i] = "\n".join(" ".join(word() for _ in range(12)) for _ in range(3)) + "\n" + passage
    texts[700] = clean[7]
    d = f"{tmp_path}/sf"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, toxic.get(i, 0)) for i in texts if i < 420], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, docs))
    assert [n for n, _ in seen] == ["toxicity", "line_dedup", "ngram_jaccard", "packing"]
    assert all(df.columns == cols for _, df in seen[:-1])
    a, b, c = ({r.doc_id: r.text for r in df.collect()} for _, df in seen[:3])
    assert len(set(a) & set(range(300, 420))) <= 6 and set(clean) <= set(a)
    assert 700 not in b and passage in b[600] and passage not in b[601] and passage not in b[602]
    assert all(b[i] == clean[i] for i in clean)
    assert set(range(500, 510)) & set(c) == {500} and set(clean) <= set(c)
    assert {r.doc_id for r in seen[3][1].select("doc_id").distinct().collect()} == set(c)
