"""The pipeline's stages on a small corpus, against the operators and brute force."""

import pytest

from .conftest import DOCS, prose


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("sf")
    item = prose(500, 30)
    good = [(i, prose(i, 40 + i % 50)) for i in range(120)]
    junk = [(200 + i, " | ".join(prose(i, 30).split()) + " ###") for i in range(120)]
    near = good[3][1].split()
    near[-1] = "other"
    special = [(400, good[2][1]), (401, " ".join(near)), (402, prose(601, 40) + " " + item), (403, prose(602, 60) + " password=abcdefghijklmnop")]
    rows = [(d, t, "en", "src0", len(t)) for d, t in good + junk + special]
    spark.createDataFrame(rows, DOCS + ", lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    labels = [(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), dict(good)


def test_stages(spark, corpus):
    import corpus_pipeline

    root, good = corpus
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, root)
        assert docs.columns == columns
        docs.write.parquet(f"{root}/stage{i}")
        docs = spark.read.parquet(f"{root}/stage{i}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, unique, clean, redacted = seen
    assert len([d for d in quality if d < 120]) >= 117 and len([d for d in quality if 200 <= d < 400]) <= 3
    assert 400 in quality and not {400, 401} & set(unique) and {2, 3, 402, 403} <= set(unique)
    assert set(unique) - set(clean) == {402}
    assert redacted[403].endswith("[REDACTED]") and {d: t for d, t in redacted.items() if d != 403} == {d: t for d, t in clean.items() if d != 403}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    assert {r.doc_id for r in packed} == set(redacted)
    assert {r.doc_id for r in corpus_pipeline.run(spark, root).collect()} == set(redacted)


def test_run_against_brute_force(spark, corpus):
    """The whole pipeline against plain Python on the same tables, but for the learned weights: which documents come through, and every packed id."""
    import zlib
    from collections import defaultdict

    import corpus_pipeline
    import numpy as np
    from tokenizers import Tokenizer

    from lintharbor.llm import packing, quality

    from .test_documents import contaminated, secrets, shingle_set

    root, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    net = quality.learn(docs, spark.read.parquet(f"{root}/labels.parquet"))
    left = {r.doc_id: r.text for r in docs.collect() if net.score([r.text.encode()])[0] >= 0.7}
    sets, parent = {d: shingle_set(t) for d, t in left.items()}, {d: d for d in left}

    def root_of(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root_of(a), root_of(b)))
                parent[y] = x
    left = {d: t for d, t in left.items() if root_of(d) == d and not contaminated(t, items)[-1]}

    def redacted(text):
        spans = [tuple(map(int, x.split(":")[1:])) for x in secrets(text)[-1].split(",") if x]
        for a, b in reversed(spans):
            text = text[:a] + "[REDACTED]" + text[b:]
        return text

    exact = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: np.array([*exact.encode(redacted(t), add_special_tokens=False).ids, 0], "<u4") for d, t in left.items()}
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, root).collect():
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id] += range(r.start, r.start + r.length)
        fill[r.sequence_id] += range(r.offset, r.offset + r.length)
    assert {d: sorted(p) for d, p in pieces.items()} == {d: list(range(len(x))) for d, x in ids.items()}
    assert all(sorted(f) == list(range(len(f))) and len(f) <= 1024 for f in fill.values())
