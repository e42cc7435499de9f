import zipfile

from pyspark.sql import functions as F

from glyphspark.functions import classify, strata
from glyphspark.operators import chars
from glyphspark.operators.surprisal import Corpus, Setup
from glyphspark.sources import cache, sinks, text
from glyphspark.streaming import counts


def test_files_and_directories(spark, tmp_path):
    (tmp_path / "b.py").write_bytes(b"x = 1\n")
    (tmp_path / "a.py").write_bytes("y = 'é'\n".encode() + b"\xff")
    (tmp_path / "c.txt").write_text("no")
    files = text.numbered(text.read_files(spark, str(tmp_path), "*.py"))
    got = {r.doc_id: r.text for r in files.collect()}
    assert got == {0: "y = 'é'\n�", 1: "x = 1\n"}


def test_trim_markers(spark):
    f = lambda t: spark.range(1).select(text.trim_markers(F.lit(t), "*** START", "*** END")).first()[0]
    assert f("licence *** START body *** END more *** END tail") == "*** START body *** END more "
    assert f("plain") == "plain" and f("*** START x") == "*** START x"


def test_capped_lines(spark):
    rows = spark.createDataFrame([(0, "= T ="), (1, "abcd"), (2, "  "), (5000, "efgh"), (9000, "ijkl"), (9001, "mn")], "line_no long, text string")
    assert [r.text for r in text.capped_lines(rows, 10).orderBy("line_no").collect()] == ["abcd", "efgh", "ij"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, body in (("lib/b.js", "b"), ("lib/a.js", "a"), ("x.min.js", "m"), ("r.md", "r")):
            z.writestr(name, body)
    rows = text.read_zip(spark, str(tmp_path / "a.zip"), ".js", "lib").collect()
    assert [(r.member, r.text) for r in rows] == [("lib/a.js", "a"), ("lib/b.js", "b")]


def test_panel_csv_round_trip(spark, tmp_path):
    keys = ['"', ",", " ", "\n", "a", "'"]
    df = spark.createDataFrame([(0.5, 1.0, 1, 1.0, -2.0, c) for c in keys], text.PANEL_SCHEMA)
    sinks.write_csv(df, str(tmp_path / "p"), 4)
    rows = text.read_panel(spark, str(tmp_path / "p")).collect()
    assert sorted(r.char_id for r in rows) == sorted(keys) and {r.k for r in rows} == {2}


def test_hex_lines_and_key_values(spark):
    rows = chars.characters(chars.corpus(spark.createDataFrame([(0, "aé🙂")], "doc_id long, text string"), separator=""), 1)
    assert [r.line for r in sinks.training_lines(rows, 2).orderBy("line_no").collect()] == ["0061 00e9", "1f642"]
    assert [tuple(r) for r in sinks.key_values(spark.createDataFrame([(1, "x")], "a int, b string")).collect()] == [("a", "1"), ("b", "x")]


def test_cache_resumes(spark, tmp_path):
    store = cache.Cache(spark, str(tmp_path / "cache"))
    make = lambda ks, v: spark.createDataFrame([(k, float(v)) for k in ks], "k int, value double")
    assert store.missing("coverage", "h1", [1, 2, 3]) == [1, 2, 3]
    store.put("coverage", make([1, 2], 0.5), "h1")
    store.put("coverage", make([1], 0.1), "h2")
    assert store.missing("coverage", "h1", [1, 2, 3]) == [3] and store.orders("coverage", "h2") == [1]
    store.put("coverage", make([2], 0.9), "h1")
    store.put_missing("coverage", make([2, 3], 0.2), "h1")
    assert {r.k: r.value for r in store.get("coverage", "h1").collect()} == {1: 0.5, 2: 0.9, 3: 0.2}
    store.put_range("h1", 3, 3, [1, 2, 3])
    assert store.get_range("h1") == (3, 3, [1, 2, 3]) and store.get_range("h9") is None
    docs = chars.corpus(spark.createDataFrame([(0, "ab")], "doc_id long, text string"), separator="")
    assert cache.corpus_hash(docs, exact=True) == "fb8e20fc2e4c3f24"


def test_strata():
    code = "def f(x):\n    return 'a.b' + 1.5  # note\n"
    got = strata.python_strata(code)
    at = lambda s: set(got[code.index(s) : code.index(s) + len(s)])
    assert at("def") == {"keyword"} and at("f(") == {"identifier", "syntax"} and at("'a.b'") == {"string"} and at("1.5") == {"numeric"} and at("# note") == {"comment"}
    assert set(strata.python_strata("x = (")) == {"other"} and strata.python_strata("") == []
    js = "a = 'it\\'s' // c\n/* \" */ b `t"
    labels = strata.js_strata(js)
    assert labels[4:11] == ["string"] * 7 and set(labels[12:16]) == {"comment"} and labels[js.index("b")] == "code" and labels[-1] == "string"


def test_code_classes_follow_strata(spark):
    code = "x.y = 1.5  # a.b\n" * 40
    c = Corpus(chars.corpus(spark.createDataFrame([(0, code)], "doc_id long, text string"), language="python", name="python"), Setup(ks=(1, 2), classifier=classify.code))
    rows = {r.ch: r for r in c.surprisal().where("k = 1").collect()}
    test = (code + "\n")[int(0.8 * 681) + 68 :]
    # The point between names is syntax, that in a number is lexical, that in a comment is left out.
    assert rows["."].type == "structural" and rows["."].n == sum(test[i] == "." and test[i - 1] in "x1" for i in range(1, len(test)))
    assert "#" not in rows and " " not in rows


def test_streaming_counts_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abcab" * i) for i in range(1, 5)], "doc_id long, text string")
    for i in range(2):
        docs.where(f"doc_id % 2 = {i}").write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    counts.start(stream, f"{tmp_path}/out", f"{tmp_path}/state", (1, 2)).awaitTermination()
    got = {(r.k, r.ctx, r.ch): r.c for r in counts.read(spark, f"{tmp_path}/out").collect()}
    assert got == {(r.k, r.ctx, r.ch): r.c for r in counts.count_batch(docs, (1, 2)).collect()}


def test_classes(spark):
    cases = {"a": "lexical", "É": "lexical", "5": "lexical", "²": "lexical", ".": "structural", " ": "ambiguous", "_": "other", "🙂": "other"}
    df = spark.createDataFrame([(c,) for c in cases], "ch string")
    assert {r.ch: r.t for r in df.select("ch", classify.nl(F.col("ch")).alias("t")).collect()} == cases
    assert df.where(classify.nl_profile(F.col("ch")) == "lexical").count() == 5
    assert df.where(classify.code_identity(F.col("ch")) == "lexical").count() == 5
