"""The pipeline stage by stage against plain versions."""

import re

import brute
import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in P.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        got = {r.doc_id: r for r in out.collect()}
        if name != "encoding":
            assert out.columns == docs.columns
        texts = {d: r.text for d, r in given.items()}
        if name == "toxicity":
            gone = given.keys() - got.keys()
            assert got.items() <= given.items() and len(gone - toxic) <= len(given) // 20 and gone
        elif name == "near_duplicates":
            assert got == {d: given[d] for d, (_, _, kept) in brute.near(texts, 5).items() if kept}
        elif name == "decontamination":
            assert got == {d: given[d] for d, x in brute.decontaminate(texts, bench).items() if not x[4]}
        elif name == "secrets":
            assert got.keys() == given.keys()
            for d, r in got.items():
                if brute.secrets(texts[d])[:3] == (0, 0, 0):
                    assert r.text == texts[d] or P.REDACTED in r.text
                else:
                    assert P.REDACTED in r.text and brute.secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text)
                pieces = [re.escape(x) for x in r.text.split(P.REDACTED)]
                assert re.fullmatch("(?s:.+)".join(pieces), texts[d], re.S)
        else:
            assert {d: list(r["ids"]) for d, r in got.items()} == {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
        docs = out


def test_null_and_empty_documents_pass(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (None, "a b c", None, "s", 5), (3, "token = abcdefgh1 x token = abcdefgh1", "en", "s", 37), (3, "token = abcdefgh1 x token = abcdefgh1", "en", "s", 37)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in docs.collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 3] and got[1][1] == got[2][1] == 0


def test_rows_with_null_or_shared_ids_are_judged_by_their_own_text(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first().text
    long = " ".join(f"word{i}" for i in range(60))
    secret, later = "token = abcdefgh1 x", "some words before it and then token = abcdefgh1 y"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = lambda *given: spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in given], schema)
    result = lambda stage, *given: sorted(((r.doc_id, r.text, r.n_chars) for r in stage(spark, rows(*given), SF).collect()), key=str)
    plain = lambda *given: sorted(((d, t, len(t)) for d, t in given), key=str)
    clean = "nothing to hide in this text"
    got = result(P.redact_secrets, (None, secret), (7, secret), (7, later), (8, later), (8, clean), (None, clean))
    cut, cut_later = f"{P.REDACTED} x", f"some words before it and then {P.REDACTED} y"
    assert got == plain((None, cut), (7, cut), (7, cut_later), (8, cut_later), (8, clean), (None, clean))
    leak = f"first {passage} last"
    assert result(P.drop_contaminated, (None, leak), (None, clean), (5, leak), (5, clean), (6, leak)) == plain((None, clean), (5, clean))
    # Null ids are documents of their own and smaller than all others; one id with other texts is other documents.
    near = long + " tail"
    assert result(P.drop_near_duplicates, (None, long), (None, long), (3, near), (3, clean), (4, clean), (None, ""), (None, "")) == plain((None, long), (3, clean), (None, ""), (None, ""))
    assert result(P.drop_near_duplicates, (1, long), (2, near), (2, clean), (2, clean), (9, clean)) == plain((1, long), (2, clean), (2, clean))


def test_extra_columns_come_back_unchanged(spark, monkeypatch):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first().text
    texts = {1: "nothing to hide in this text", 2: f"first {passage} last", 3: "token = abcdefgh1 x", 4: None, 5: "nothing to hide in this text"}
    extra = ["score", "of", "spans", "gone", "kept_id", "_key", "_digest", "row", "key", "digest", "clean", "owner", "id", "component_id", "start", "source"]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` struct<a: string, b: int>" if i % 2 else f"`{c}` date" for i, c in enumerate(extra))
    for sent in (200_000, 0):
        monkeypatch.setattr(P, "SENT_MARKS", sent)
        docs = spark.createDataFrame([(d, t, 5, *[(f"v{d}", i) if i % 2 else None for i in range(len(extra))]) for d, t in texts.items()], schema)
        want = {d: r for d, r in ((r.doc_id, r.asDict(True)) for r in docs.collect())}
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.schema.names == ["doc_id", "text", "n_chars", *extra], name
        got = {r.doc_id: r.asDict(True) for r in docs.collect()}
        assert got.keys() == {1, 3, 4}  # 2 holds a passage, 5 is a copy of 1
        for d, r in got.items():
            if d == 3:
                assert r["text"] == f"{P.REDACTED} x" and r["n_chars"] == len(r["text"])
            assert {c: v for c, v in r.items() if d != 3 or c not in ("text", "n_chars")} == {c: v for c, v in want[d].items() if d != 3 or c not in ("text", "n_chars")}

