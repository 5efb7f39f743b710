import json

import pytest
from pyspark.sql import functions as F

from textyard.operators import prepare
from textyard.sources import labelled_csv, results, reviews, vectors
from textyard.streaming.ingest import ingest_reviews
from textyard.streaming.state import ingest_until


def test_csv_round_trip(spark, tmp_path):
    rows = [('say "hi", she\nsaid', 1), ("plain", 0), ("NA", 1), (None, 0), ("two\n\nlines", 1)]
    df = spark.createDataFrame(rows, "text string, label int")
    labelled_csv.write_labelled_csv(df, str(tmp_path / "out"))
    back = labelled_csv.read_labelled_csv(spark, str(tmp_path / "out"))
    want = sorted((r if r[0] != "NA" else (None, 1) for r in rows), key=str)
    assert sorted(map(tuple, back.collect()), key=str) == want
    assert back.dtypes == [("text", "string"), ("label", "int")]


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('game,label,text\nx,1,"good, very"\ny,0,bad\n')
    got = labelled_csv.read_labelled_csv(spark, str(path), labelled_csv.REVIEWS)
    assert sorted(map(tuple, got.collect())) == [("bad", 0, "y"), ("good, very", 1, "x")]
    with pytest.raises(ValueError, match="comment_text"):
        labelled_csv.read_labelled_csv(spark, str(path), labelled_csv.COMMENTS)
    both = labelled_csv.read_sources(spark, {"a": str(path), "b": str(path)})
    assert both.groupBy("source").count().count() == 2


def test_binarise(spark):
    rows = [(0, 0, 0), (0, 1, 0), (1, 1, 1), (None, None, None), (None, 1, 0)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "c string, a int, b int, d int")
    got = prepare.binarise(df, "c", ["a", "b", "d"]).orderBy("text")
    assert [r.label for r in got.collect()] == [0, 1, 1, 0, 1]


def test_results_round_trip_and_fallback(spark, tmp_path):
    record = {"vectorizer": "bow", "embedding_dim": 10, "accuracy": 0.5, "f1_macro": 0.25}
    path = tmp_path / "r.json"
    path.write_text(json.dumps([record, {**record, "vectorizer": "tfidf"}], indent=2))
    got = results.read_results(spark, str(tmp_path / "absent.json"), "toxic", str(path))
    assert {r.vectorizer for r in got.collect()} == {"bow", "tfidf"}
    with pytest.raises(FileNotFoundError):
        results.read_results(spark, str(tmp_path / "absent.json"), "toxic").count()
    results.write_results(got, str(tmp_path / "out"))
    back = results.read_result_table(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, got.collect()))
    assert results.results_union(got, None).count() == 2


def test_vector_text_last_wins(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4 \na 5 6\n\n")
    table = vectors.dedupe_last(vectors.read_vector_text(spark, str(tmp_path / "v.txt")), "word", "seq")
    assert {r.word: r.vector for r in table.collect()} == {"a": [5.0, 6.0], "b": [3.0, 4.0]}


def pages():
    def page(success, *items):
        return {"success": success, "cursor": "c", "reviews": list(items)}

    def item(n, **more):
        return {"review": "  " + "x" * n + "\n", **more}

    return [
        page(1, item(19, voted_up=True), item(20, voted_up=True), item(512), item(513, voted_up=False)),
        page(0, item(100, voted_up=True)),
        page(1),
        page(1, {"voted_up": True}, item(30, voted_up=False)),
    ]


def test_flatten_reviews(spark, tmp_path):
    for i, p in enumerate(pages()):
        (tmp_path / f"{i}.json").write_text(json.dumps(p))
    got = reviews.flatten_reviews(reviews.read_pages(spark, str(tmp_path)))
    assert sorted((len(r.text), r.label) for r in got.collect()) == [(20, 1), (30, 0), (512, 0)]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    landing, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landing.mkdir()
    for i, p in enumerate(pages()):
        (landing / f"{i}.json").write_text(json.dumps(p))
        ingest_reviews(spark, str(landing), out, state).awaitTermination()
    batch = reviews.flatten_reviews(reviews.read_pages(spark, str(landing)))
    streamed = spark.read.parquet(out)
    assert sorted(map(tuple, streamed.select("text", "label").collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.filter(F.col("clean").isNull()).count() == 0


def sourced(source, page, success, cursor, *lengths):
    items = [{"review": f"{source}{page}{i}".ljust(n, "x"), "voted_up": bool(i % 2)} for i, n in enumerate(lengths)]
    return {"source": source, "page": page, "success": success, "cursor": cursor, "reviews": items}


def test_stateful_ingestion_equals_batch(spark, tmp_path):
    landing, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landing.mkdir()
    a = [sourced("a", i, 1, "c", 30, 19, 40, 25) for i in range(4)]
    b = [sourced("b", 0, 1, "c", 50, 60), sourced("b", 1, 0, "c", 70), sourced("b", 2, 1, "c", 80)]
    c = [sourced("c", 0, 1, "c", 20), sourced("c", 1, 1, "", 22, 10), sourced("c", 2, 1, "c", 23)]
    d = [sourced("d", 0, 1, "c", 20), sourced("d", 1, 1, "c"), sourced("d", 2, 1, "c", 23)]
    # late, early and repeated files over four runs; each run restarts from the state folder
    runs = [[a[1], b[0], c[0], d[0]], [a[0], a[1], b[2], c[2], c[1]], [a[3], b[1], a[0], d[2]], [a[2], b[0], d[1]]]
    for n, files in enumerate(runs):
        for i, page in enumerate(files):
            (landing / f"{n}-{i}.json").write_text(json.dumps(page))
        ingest_until(spark, str(landing), out, state, 7).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).select("source", "text", "label").collect()))
    pages = spark.read.schema(reviews.SOURCED_PAGE).option("multiLine", True).json(str(landing))
    batch = sorted(map(tuple, reviews.take_reviews(pages, 7).collect()))
    assert got == batch
    assert [sum(r[0] == s for r in got) for s in "abcd"] == [7, 2, 2, 1]


def test_take_reviews_with_one_hot_source_and_nulls(spark):
    rows = [("hot", i, 1, "c", [("x" * 25, True)] * 3) for i in range(400)] + [(None, 0, 1, None, [("y" * 30, None)]), (None, 1, 1, "c", [("z" * 30, True)])]
    rows += [("odd", 0, None, "c", [("x" * 25, True)]), ("none", 0, 1, "c", None)]
    pages = spark.createDataFrame(rows, reviews.SOURCED_PAGE)
    got = reviews.take_reviews(pages, 1_000).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"hot": 1_000, None: 1}


def test_sql_functions_equal_the_columns_and_stay_native(spark):
    from textyard.functions import sql, text as tx

    texts = ["You're an IDIOT!! Visit http://spam.com for more", None, "", "<b>Bold</b> WWW.x.com\u00a0end été", "a<b and c>d <i", "x://y don't"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sql.register(spark)
    got = spark.sql("SELECT id, clean_text(t) AS c, text_bigrams(text_tokens(t)) AS g FROM {docs}", docs=docs)
    want = docs.select("id", tx.clean("t").alias("c"), tx.ngrams(tx.tokens("t")).alias("g"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "regexp" in plan


def adversarial_csv(n, seed):
    """Rows whose texts hold quotes, commas, line breaks and blank lines, as a CSV writer quotes them."""
    import csv
    import io
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice(['"', ",", "\n", "\n\n", "x", "é", " ", '""', "\r\n", '\n"', '",\n']) for _ in range(rng.choice((1, 3, 10, 120))))
        rows.append((f"{i}{text}", i % 2))
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["text", "label"])
    writer.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("block", ["37b", "211b", "1m"])
def test_split_csv_equals_the_whole_read(spark, tmp_path, block):
    want = []
    for i in range(3):
        text, rows = adversarial_csv(80, i)
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
        want += rows
    (tmp_path / "3.csv").write_bytes(b"\xef\xbb\xbflabel,extra,text\n1.0,x,reordered\n\n0,y,\"two\n\nlines\"")
    want += [("reordered", 1), ("two\n\nlines", 0)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        if block == "211b":
            assert labelled_csv.records(spark, str(tmp_path)).select("file", "block").distinct().count() > 40
        got = labelled_csv.read_labelled_csv(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("text,label\n")
    assert labelled_csv.read_labelled_csv(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "n.csv").write_text("")
    assert labelled_csv.read_labelled_csv(spark, str(tmp_path / "n.csv")).dtypes == [("text", "string"), ("label", "int")]


def test_last_vector_wins_over_files_and_blocks(spark, tmp_path):
    """A longer earlier file must not pass a later one, nor a later block an earlier one."""
    (tmp_path / "a.txt").write_text("".join(f"w{i % 7} {i} 0\n" for i in range(700)))
    (tmp_path / "b.txt").write_text("w1 -1 -1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        def last(path):
            return {r.word: r.vector[0] for r in vectors.dedupe_last(vectors.read_vector_text(spark, path), "word", "seq").collect()}

        own = {f"w{i % 7}": float(i) for i in range(700)}
        assert last(str(tmp_path)) == own | {"w1": -1.0}
        a, b = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
        assert last([b, a]) == own and last([a, b])["w1"] == -1.0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
