"""Reading trees, storing results per project, and counting files as they are scanned."""

from pyspark.sql import functions as F

from tracewell.operators import corpus
from tracewell.sources import files


def test_tree_to_lines(spark, tmp_path):
    (tmp_path / "pkg" / ".git").mkdir(parents=True)
    (tmp_path / "pkg" / "a.py").write_bytes("one\r\ntwo\rthree\n".encode())
    (tmp_path / "pkg" / "b.py").write_bytes(b"x\0y")
    (tmp_path / "pkg" / "c.py").write_bytes(b"\xff\xfe")
    (tmp_path / "pkg" / "big.py").write_text("x" * 50)
    (tmp_path / "pkg" / ".git" / "h.py").write_text("hidden")
    (tmp_path / "pkg" / "t.d.ts").write_text("declare")
    tree = files.read_tree(spark, str(tmp_path))
    kept, skipped = corpus.scan_corpus(tree, max_bytes=20)
    assert {r.path for r in kept.collect()} == {"pkg/a.py", "pkg/b.py", "pkg/c.py"}
    assert [(r.path, r.reason) for r in skipped.collect()] == [("pkg/big.py", "file_too_large")]
    lines = corpus.explode_lines(kept).orderBy("line").collect()
    assert [(r.path, r.line, r.text) for r in lines] == [("pkg/a.py", 1, "one"), ("pkg/a.py", 2, "two"), ("pkg/a.py", 3, "three")]


def test_only_written_projects_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "results")
    rows = lambda *r: spark.createDataFrame(list(r), "project_id string, path string, sha256 string, bytes long, lines long")
    files.write_artifact(rows(("p", "a", "1", 1, 1), ("q", "b", "2", 1, 1)), folder)
    before = files.artifact_revision(files.read_artifact(spark, folder)).first().revision
    files.write_artifact(rows(("p", "a", "3", 1, 1)), folder)
    assert {(r.project_id, r.sha256) for r in files.read_artifact(spark, folder).collect()} == {("p", "3"), ("q", "2")}
    assert files.artifact_revision(files.read_artifact(spark, folder)).first().revision != before


def test_revision_ignores_partitioning(spark):
    rows = spark.range(500).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("x").alias("sha256"), F.col("id").alias("bytes"), F.lit(1).alias("lines"))
    digests = {files.artifact_revision(rows.repartition(n)).first().revision for n in (1, 5, 13)}
    assert len(digests) == 1


def test_deployment_lines_follow_the_match(spark):
    text = "# CMD fake\nFROM x\n\n  CMD run\nRUN y\nENTRYPOINT [\"a\"]"
    got = corpus.deployment_commands(spark.createDataFrame([("d/Dockerfile", text)], "path string, text string")).collect()
    assert sorted((r.line, r.label, r.command, r.shell_interpreted) for r in got) == [(3, "CMD", "run", True), (6, "ENTRYPOINT", '["a"]', False)]


def test_command_words(spark):
    raw = ["python 'a b.py' --x=\"1 2\"", '["/bin/sh", "-c", "x"]', "echo 'open", "make && run", "a\\ b c"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, c string").select("i", corpus.command_fact("c").alias("f")).orderBy("i")
    got = [(r.f.argv, r.f.launcher, r.f.shell_interpreted) for r in df.collect()]
    assert got == [(["python", "a b.py", "--x=1 2"], "python", False), (["/bin/sh", "-c", "x"], "sh", False), ([], None, False), (["make", "&&", "run"], "make", True), (["a b", "c"], "a b", False)]


def test_inventory_of_frameworks(spark):
    text = '{"dependencies": {"vue": "3"}, "devDependencies": {"vite": "5", "left-pad": "1"}}'
    got = corpus.package_frameworks(spark.createDataFrame([("package.json", text), ("x/package.json", "{")], "path string, text string")).collect()
    assert {(r.path, r.framework) for r in got} == {("package.json", "Vue"), ("package.json", "Vite")}


def test_tombstones_rewrite_only_their_partitions(spark, tmp_path):
    """Null flags and protected rows stay; a second run finds nothing to do."""
    from tracewell.sources.files import read_artifact, write_artifact, write_tombstones

    rows = [(1, "a", "done", False, True, 5, 1), (2, "b", "done", True, True, 5, 1), (3, "c", "done", None, True, 5, 1), (4, "d", "done", False, True, 50, 2), (5, "e", "open", False, False, 5, 2), (6, "f", "done", False, True, 5, None)]
    folder, now = f"{tmp_path}/sessions", F.lit(10)
    write_artifact(spark.createDataFrame(rows, "id int, body string, status string, protected boolean, terminal boolean, expires_at int, month int"), folder, "month")
    files = lambda month: {p.name for p in (tmp_path / "sessions" / f"month={month}").iterdir()}
    first, second = files(1), files(2)
    want = {1: (None, "expired"), 2: ("b", "done"), 3: ("c", "done"), 4: ("d", "done"), 5: ("e", "open"), 6: (None, "expired")}
    write_tombstones(spark, folder, "month", now)
    assert {r.id: (r.body, r.status) for r in read_artifact(spark, folder).collect()} == want
    assert files(2) == second and not files(1) & first
    again = files(1)
    write_tombstones(spark, folder, "month", now)
    assert {r.id: (r.body, r.status) for r in read_artifact(spark, folder).collect()} == want and files(1) == again


def test_sink_is_compacted(spark, tmp_path):
    """Twelve drains with a compaction every four: few folders, and always the newest version of each row."""
    from pyspark.sql import functions as F

    from tracewell.streaming import feeds

    schema = spark.createDataFrame([(1, 1)], "k long, v long").schema
    counts = []
    for i in range(12):
        spark.createDataFrame([(k, i) for k in range(i % 5, 20)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        feeds.upsert_available(stream.groupBy("k").agg(F.max("v").alias("v")), f"{tmp_path}/sink", f"{tmp_path}/checkpoint", ["k"], compact_every=4)
        got = {r.k: r.v for r in feeds.latest_rows(spark, f"{tmp_path}/sink", ["k"]).collect()}
        assert got == {k: max(j for j in range(i + 1) if k >= j % 5) for k in range(20) if any(k >= j % 5 for j in range(i + 1))}
        counts.append(len([p for p in (tmp_path / "sink").iterdir() if p.name.startswith("batch=")]))
    assert max(counts) <= 5 and counts[-1] < 5
