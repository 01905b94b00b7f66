"""Rows without an id, with one id and with equal contents stay rows of their own."""

import pytest

pytest.importorskip("tilth.llm")
import public_tokenizers  # noqa: E402

from tilth.llm import byte_bpe, embedding_join, language_id, licenses, personal_data, quality, secret_scan, simhash  # noqa: E402

TEXTS = ["the token = 'abcdefgh1234' under cc by", "the token = 'abcdefgh1234' under cc by", None, "", "a text of another kind with some words in it"]
IDS = [None, None, 7, 7, 7]


def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in zip(IDS, TEXTS, strict=True)], "doc_id long, text string, lang string")


def ids(rows, name="doc_id"):
    return sorted(str(r[name]) for r in rows)


def test_scans_keep_every_row(spark):
    d = docs(spark)
    want = sorted(map(str, IDS))
    stats = quality.document_statistics(d)
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    outs = {
        "licenses": licenses.scan(d), "secrets": secret_scan.scan(d), "personal": personal_data.scan(d), "language": language_id.identify(d, language_id.train(d)),
        "quality": quality.score(stats, quality.train(stats, labels)), "bytes": byte_bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "simhash": simhash.near_duplicates(d),
    }
    for name, out in outs.items():
        assert ids(out.collect()) == want, name
    found = [r for r in outs["secrets"].collect() if r["doc_id"] is None]
    assert len(found) == 2 and all([s["kind"] for s in r["spans"]] == ["assign"] for r in found)
    assert sorted(r["base_labels"] for r in outs["licenses"].collect()) == ["", "", "", "cc-by", "cc-by"]


def test_vectors_without_or_with_one_id(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None)]
    got = embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.9).collect()
    assert ids(got, "vec_id") == ["3", "3", "3", "4", "None", "None"]
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in got) == [("3", 1), ("3", 1), ("3", 2), ("4", 0), ("None", 2), ("None", 2)]
    assert {r["component_id"] for r in got if r["vec_id"] == 3} == {3}
    assert sorted(str(r["component_id"]) for r in got if r["vec_id"] is None) == ["3", "None"]  # without an id: by equal vectors only
