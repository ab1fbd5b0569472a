"""The stages on a small fixture, each against brute force on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import WORD, brute_near, brute_words  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = say(55)
    texts = [say(rnd.randint(60, 150)) for _ in range(40)]
    texts += [texts[0], texts[1].replace(" ", "  ", 4), texts[2] + " more", say(10), f"{say(60)}\n{passage}", f"{passage} {say(60)}", None]
    texts += [" ".join(w + "%%" for w in say(70).split()) for _ in range(30)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("%%" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = step(spark, docs, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = corpus_pipeline.stage(out, name)
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            assert set(kept[name]) == {i for i, t in before.items() if t and "%%" not in t and len(WORD.findall(t)) >= 50}
        elif name == "exact_dedup":
            assert set(before) - set(kept[name]) == {40, 41}
        elif name == "near_dedup":
            assert set(kept[name]) == {i for i, v in brute_near(before.items(), 5, 80).items() if v[2]} and 42 not in kept[name]
        elif name == "substring_dedup":
            for i, n, gone, text in brute_words(before.items(), 35):
                row = kept[name][i]
                assert " ".join(WORD.findall(row["text"])) == text and row["n_chars"] == len(row["text"]) and (gone or row["text"] == before[i])
            assert kept[name][44]["text"].startswith(before[44].split("\n")[0])
        else:
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before) and max(r["offset"] + r["length"] for r in rows) <= 2048


CLASHES = "doc_id long, text string, lang string, n_chars long, `a.b` string, m map<string,string>, _gone long, _k long, _key long, _h long, row string, touched boolean, h long, id long, node binary, block int, bad int"


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_on_empty_null_repeated_and_clashing_tables(spark, tmp_path, kind):
    """Every stage returns the rows and columns it says; row by row where a doc_id or a text is missing or comes again."""
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(70))
    fill = ("en", 5, "x", {"k": "v"}, 1, 2, 3, 4, "r", True, 5, 6, b"n", 7, 8)
    rows = [(None, text, *fill), (None, None, *[None] * 15), (1, text, *fill), (1, text, *fill), (1, other, *fill), (2, None, *fill), (3, "", *fill), (4, "a " * 200_000, *fill), (5, other + " tail", *fill)]
    docs = spark.createDataFrame(rows if kind == "odd" else [], CLASHES)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (9, None, 0)] if kind == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {
        "quality_rules": ["1 v", "1 w", "1 w", "5 v", "None w"], "exact_dedup": ["1 v", "1 w", "2 None", "4 a", "5 v"],
        "near_dedup": ["1 v", "1 w", "1 w", "2 None", "3 ", "4 a", "None None", "None w"], "substring_dedup": 9, "best_fit_packing": 9,
    }
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        got = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if kind == "empty":
            assert got == []
        elif name == "best_fit_packing":
            assert len({(r["doc_id"], r["piece"], r["ids_crc32"], r["length"]) for r in got}) > 9
        elif name == "substring_dedup":
            assert len(got) == 9 and {r["text"] for r in got if r["doc_id"] == 3} == {""} and [r["text"] for r in got if r["doc_id"] is None and r["_gone"] is None] == [None]
        else:
            assert sorted(f"{r['doc_id']} {r['text'][:1] if r['text'] is not None else None}" for r in got) == want[name]
