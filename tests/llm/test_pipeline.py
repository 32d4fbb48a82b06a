"""The corpus pipeline, stage by stage, on a small corpus."""

import random
import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as pipeline  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(80)]
        bad = i % 4 == 1
        if bad:
            text = [w + "###" for w in text]
        if i % 10 == 8:
            text[40] = "token='Ab3dEf6hIj9lMn2p'"
        rows.append([i, " ".join(text), "en", "s", 0])
        labels.append((i, int(not bad), 0))
    rows[20][1] = rows[22][1].upper()  # an exact copy but for case
    rows[30][1] = rows[32][1].replace(rows[32][1].split()[5], "edit", 1)  # a near copy
    rows += [[240, None, None, None, None], [241, "", "en", "s", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    assert [name for name, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    good = pipeline.quality_stage(spark, docs, sf_dir)
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and len([i for i in ids if i % 4 == 1]) <= 3 and len([i for i in range(240) if i % 4 != 1 and i not in ids]) <= 3
    exact = pipeline.exact_stage(spark, docs, sf_dir)
    kept = {r.doc_id for r in exact.collect()}
    assert {r.doc_id for r in docs.collect()} - kept == {20, 240} and exact.columns == docs.columns
    near = pipeline.near_stage(spark, docs, sf_dir)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in near.collect()} == {22, 32} and near.columns == docs.columns
    clean = {r.doc_id: r for r in pipeline.secrets_stage(spark, docs, sf_dir).collect()}
    assert len(clean) == 242 and "[SECRET]" in clean[8].text and "Ab3d" not in clean[8].text and clean[8].n_chars == len(clean[8].text) and clean[2].text == docs.where("doc_id = 2").first().text
    packed = pipeline.packing_stage(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(range(242))


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_run(spark, sf_dir):
    """Every document that brute force keeps is packed whole, with its secrets replaced, and no other is."""
    import public_tokenizers
    from test_operators import ASSIGN, lower, near
    from tokenizers import Tokenizer

    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"} <= set(rows[0].asDict())
    good = {r.doc_id: r.text for r in pipeline.quality_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    last = {}
    for i in sorted(good):
        last[lower(good[i])] = i
    exact = sorted(last.values())
    first = {}
    for k, (_, component) in near([good[i] or "" for i in exact], 80).items():
        first.setdefault(component, exact[k])
    kept = sorted(first.values())
    assert 20 not in kept and 32 not in kept and 30 in kept and 22 in kept
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    secret = [i for i in kept if "Ab3dEf6hIj9lMn2p" in (good[i] or "")]
    want = {i: ASSIGN.sub("[SECRET]", good[i] or "") for i in kept}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    assert len(secret) > 5 and all("Ab3d" not in tok.decode(got[i]) for i in kept)
