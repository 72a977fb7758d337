import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import exact_dedup, mixing, toxicity
from plumbline.llm.common import hold
from plumbline.session import BATCH_BYTES

from test_jaccard import brute

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
COLUMNS = "doc_id long, text string, lang string, source string, kept string, weight double, id int, score double"


def corpus():
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("sto", "riv", "tre", "hil", "sea", "win") for b in ("ne", "er", "es", "ls", "ment", "tion")]
    docs, labels = [], []

    def add(text, lang="en", source="web"):
        docs.append((len(docs), text, lang, source, "k", 1.0, 3, 0.5))
        return len(docs) - 1

    for i in range(260):
        body = [words[j] for j in rng.integers(len(words), size=int(rng.integers(8, 60)))]
        toxic = i % 5 == 0
        if toxic:
            body[int(rng.integers(len(body)))] = "vile" + "abcd"[i % 4]
        at = add(" ".join(body), ("en", "de", None)[i % 3], "web" if i % 3 else ("book", None)[i % 2])
        labels.append((at, int(toxic)))
        if i % 6 == 1:
            add(" ".join(body), "en", "copy")
        if i % 6 == 2 and len(body) > 40:
            add(" ".join(body[:-1]), "de", "copy")
    for _ in range(120):
        add("the same clean text in a large group of copies over and over", "en", "hot")
    for t in (None, "", "", " \n", None):
        add(t)
    add("q" * 30_000 + " " + " ".join(words * 40))
    docs.append((None, "a row without a key that nothing else equals", "en", "web", None, None, None, None))
    docs.append(docs[7])
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_equal_plain_versions(spark, folder):
    """Every stage against a plain version on what the one before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    net = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def step(name, keep):
        nonlocal docs
        given = [tuple(r) for r in docs.collect()]
        out = hold(stages[name](spark, docs, folder))
        assert out.columns == docs.columns
        want = keep(given)
        assert rows(out) == sorted(want, key=repr) and 0 < len(want) < len(given), name
        docs = out

    def clean(given):
        tops = toxicity.window_logits(net, [r[1] or "" for r in given])
        return [r for r, w in zip(given, tops) if not len(w) or w.max() < 0]

    step("toxicity", clean)
    gone = {r[0] for r in corpus()[0]} - {r.doc_id for r in docs.collect()}
    toxic = {i for i, t in corpus()[1] if t}
    assert len(toxic & gone) > 0.95 * len(toxic) and len(gone) < 1.25 * len(toxic)

    def unlike(given):
        best = {}
        for r in given:
            if r[0] is not None:
                best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0])
        return [r for r in given if r[0] is None or best[r[1] or ""] == r[0]]

    step("exact dedup", unlike)

    def first_of_group(given):
        found = brute({r[0]: r[1] for r in given if r[0] is not None}, 5, 80)
        return [r for r in given if r[0] is None or found[r[0]][1] == r[0]]

    step("n-gram Jaccard join", first_of_group)

    def mixed(given):
        db = duckdb.connect()
        files = [f.removeprefix("file://") for f in docs.inputFiles()]
        db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet({files!r})")
        sql = mixing.oracle(corpus_pipeline.POWER, corpus_pipeline.ROUNDS)
        stay = {i for i, in db.sql(f"SELECT doc_id FROM ({sql}) WHERE kept").fetchall()}
        return [r for r in given if r[0] in stay]

    step("mixing sources", mixed)
    packed = hold(stages["packing"](spark, docs, folder)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = {}
    for p in sorted(packed, key=lambda p: p.start):
        by_doc[p.doc_id] = by_doc.get(p.doc_id, b"") + p.ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in texts.items()}
    times = {i: sum(r.doc_id == i for r in docs.collect()) for i in texts}
    assert by_doc.keys() == want.keys()
    assert all(len(by_doc[i]) == times[i] * len(want[i]) for i in want)
    assert all(by_doc[i] == want[i] for i in want if times[i] == 1)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, ((p.doc_id, p.length) for p in whole))) == sorted(map(repr, ((p.doc_id, p.length) for p in packed)))


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_for_workers_are_small(spark):
    """Long texts don't go to a worker in one batch, whatever the number of rows."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    before = spark.conf.get(BATCH)
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 10000) AS text")
    stage = corpus_pipeline._alone(lambda spark, docs, folder: docs.mapInArrow(sizes, "n long, size long"))
    try:
        spark.conf.unset(BATCH)
        got = stage(spark, docs, "").collect()
        assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 2 * BATCH_BYTES
        spark.conf.set(BATCH, "1m")
        assert len(stage(spark, docs, "").collect()) > 15 and spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.set(BATCH, before)


def test_rows_without_a_key_stand_alone(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (2**60 + 1, "a"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in exact_dedup.group_equal_texts(df).collect()), key=repr)
    top = 2**60 + 1
    assert got == sorted([(1, top, 2, False), (top, top, 2, True), *[(None, None, 1, True)] * 3], key=repr)
