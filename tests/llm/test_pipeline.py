import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import bpe
from tessera.llm.common import saved
from tessera.llm.queries import ORACLES, QUERIES, tokenizer_file

from .helpers import documents, shingles
from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as groups
from .test_lines_chat import brute as cleaned

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        out.append((name, docs.toPandas()))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in stages] == ["documents", "toxicity", "line_dedup", "near_dedup", "decontaminate", "encode"]
    assert all(list(d.columns) == COLUMNS for _, d in stages[:-1])
    assert stages[-1][1].columns[0] == "doc_id"


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    before, after = set(stages[0][1].doc_id), set(stages[1][1].doc_id)
    assert after < before
    gone = labels[labels.index.isin(before - after)]
    stay = labels[labels.index.isin(after)]
    assert (gone == 1).mean() > 0.95 and (stay == 0).mean() > 0.94


def test_lines_go(stages):
    rows = list(stages[1][1][["doc_id", "text", "source"]].itertuples(index=False, name=None))
    want = {k: t for k, t, _, _ in cleaned(rows, 5)}
    got = stages[2][1]
    assert dict(zip(got.doc_id, got.text)) == want and (got.n_chars == got.text.str.len()).all()


def test_one_of_each_group_stays(stages):
    rows = list(stages[2][1][["doc_id", "text"]].itertuples(index=False, name=None))
    inverted = {}
    want = {c for _, n, c in groups_fast(rows, inverted)}
    assert set(stages[3][1].doc_id) == want and stages[3][1].doc_id.is_unique


def groups_fast(rows, inverted):
    """Brute force over pairs that share a shingle."""
    from .helpers import unite
    sets = [shingles(t) for _, t in rows]
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    pairs = {(a, b) for v in inverted.values() for a in v for b in v if b < a}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = unite(len(rows), links)
    least = {}
    for (key, _), r in zip(rows, root):
        least[r] = min(least.get(r, key), key)
    return [(k, len(s), least[r]) for (k, _), s, r in zip(rows, sets, root)]


def test_contaminated_documents_go(spark, stages):
    rows = list(stages[3][1][["doc_id", "text"]].itertuples(index=False, name=None))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {k for k, _, hit, _ in contaminated(rows, items) if not hit}
    assert set(stages[4][1].doc_id) == clean and len(clean) < len(rows)


def test_ids_are_the_library_s(stages):
    tok = bpe.loaded(bpe.read_tokenizer(tokenizer_file()))
    text = dict(zip(stages[4][1].doc_id, stages[4][1].text))
    got = stages[5][1]
    assert set(got.doc_id) == set(text)
    for key, ids, back in zip(got.doc_id, got["ids"], got.decoded):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text[key], add_special_tokens=False).ids
        assert back == text[key]


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == list(stages[-1][1].columns) and got.count() == len(stages[-1][1])


def test_stages_take_empty_tables(spark, tmp_path):
    docs = documents(spark, []).selectExpr("doc_id", "text", "key as lang", "source", "cast(n as long) as n_chars")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)), "empty")
        assert docs.count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_bpe_digests(spark):
    tok = bpe.loaded(bpe.read_tokenizer(tokenizer_file()))
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()
    got = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, SF).collect()}
    for r in rows:
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids, "<u4")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
