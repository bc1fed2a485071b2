import corpus_pipeline as C
from test_documents import brute_classes, variants
from tracelab.llm import _shared as S
from tracelab.llm import lines, neardup

D = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = S.table(spark, D, "documents")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = S.written(stage(spark, docs, D), f"test-{name}")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[-1] > 0.6 * seen[0]
    assert neardup.near_duplicates(docs).where("NOT kept").count() == 0
    assert lines.dedup_lines(docs).where("_line_deleted > 0").count() == 0
    packed = C.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_filters_handle_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "s", 5), (2, long, "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.dedup_lines(spark, docs, D).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in C.dedup_documents(spark, docs, D).collect()) == [1, 3]


def odd_table(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the names that stages use themselves."""
    say = {"en": "the river ran past the old mill and the children played by the water until evening", "de": "der alte mann ging durch den wald und suchte nach seinem hund bis zum abend"}
    rows = [(i, f"{x} {'abcdefghij'[i % 10] * 4} {'klmnopqrst'[i // 10 % 10] * 5} " * (2 + i % 3), lang, "s", 1, "y", 1.5, True, 7, 3, "z") for i, (lang, x) in enumerate([*say.items()] * 60)]
    rows += [(200, None, "en", "s", None, "y", 1.5, True, 7, 3, "z"), (201, "", "en", None, 0, None, None, None, None, None, None), (None, rows[0][1], None, "s", 9, "y", 1.5, True, 7, 3, "z")]
    rows += [rows[5]] * 3 + [(300, say["en"] + " " + "the water ran by the mill " * 20_000, "en", "s", 5, "y", 1.5, True, 7, 3, "z")]
    names = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, accepted boolean, _toxicity int, _raw int, _line_whole string"
    return spark.createDataFrame(rows, names)


def test_every_stage_handles_odd_rows_and_clashing_names(spark):
    docs = odd_table(spark)
    kept = {}
    for name, stage in C.STAGES[:-1]:
        out = S.written(stage(spark, docs, D), f"odd-{name}")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert all(tuple(r)[5:] in {("y", 1.5, True, 7, 3, "z"), (None,) * 6} for r in rows)
        kept[name] = sorted(((-1 if r.doc_id is None else r.doc_id) for r in rows))
        assert stage(spark, docs.where("false"), D).count() == 0
    assert not {200, 201} & set(kept["language"]) and {-1, 5, 300} <= set(kept["language"]) and kept["language"].count(5) == 4
    assert len(kept["toxicity"]) == docs.count()
    assert kept["lines"].count(5) == 1 and {200, 201} <= set(kept["lines"]) and -1 not in kept["lines"]
    assert kept["neardup"].count(5) <= 1 and {200, 201} & set(kept["neardup"]) == {200} and -1 not in kept["neardup"]
    packed = C.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_a_run_from_an_empty_table(spark, tmp_path):
    S.table(spark, D, "documents").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    S.table(spark, D, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_one_document_of_a_large_family_stays_for_each_class(spark):
    rows = variants(1, 400, 100, 8)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(set(brute_classes(rows).values()))
    assert sorted(r.doc_id for r in C.dedup_documents(spark, docs, D).collect()) == want
