"""Tables, text trees, samples and written outputs."""

from __future__ import annotations

import csv
import os

import pytest
from pyspark.sql import functions as F

from tests.plans import plan_text
from tokentide.functions.paths import parent
from tokentide.functions.tokenizers import WORDS, Bytes, Chars
from tokentide.operators import corpus
from tokentide.operators.align import TokenizerSet
from tokentide.operators.evaluate import parse_responses, result_rows, score_responses
from tokentide.operators.ordering import with_position
from tokentide.plans import jobs
from tokentide.session import materialize, scratch_path, start
from tokentide.sinks.results import write_results
from tokentide.sinks.tables import counted_path, read_band, write_split
from tokentide.sources.samples import as_samples, first_samples, read_samples
from tokentide.sources.tables import read_counts, tag_inputs, with_row_id
from tokentide.sources.text_files import FILE_BYTES, _packed, list_tree, normal_extensions, normal_path, read_text_files


def test_row_ids_across_part_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 7).write.parquet(path)
    found = with_row_id(spark.read.parquet(path)).orderBy("row_id").collect()
    assert [r.row_id for r in found] == list(range(100))
    assert [r.id for r in found] == list(range(100))


def test_read_counts_checks_the_column(spark, rows, tmp_path):
    def table(name, data, schema):
        path = str(tmp_path / name)
        rows(data, schema).coalesce(1).write.parquet(path)
        return path

    good = table("good", [(3, "a"), (4, "b")], "n int, g string")
    assert [tuple(r) for r in read_counts(spark, good, "n", label="g").collect()] == [(0, 3, "a"), (1, 4, "b")]
    with pytest.raises(ValueError, match="missing"):
        read_counts(spark, good, "m")
    with pytest.raises(TypeError):
        read_counts(spark, good, "g")
    with pytest.raises(TypeError):
        read_counts(spark, good, "n", label="n")
    for bad in (None, -1):
        with pytest.raises(Exception, match="invalid count"):
            read_counts(spark, table(f"bad{bad}", [(1, "a"), (bad, "b")], "n int, g string"), "n").collect()
    with pytest.raises(Exception, match="null value"):
        read_counts(spark, table("nulls", [(1, None)], "n int, g string"), "n", label="g").collect()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree (1)"
    texts = {
        "top.md": "one two", "b/10.md": "x", "b/2.md": "y y", "b/deep/1.MD": "z z z", "b/skip.txt": "no",
        "out/1.md": "excluded", "outer/1.md": "kept", "_hidden/__init__.md": "h h", ".md": "no extension",
        "b/é %20.md": "ü",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    os.symlink(root / "top.md", root / "_link.md")
    os.symlink(root / "top.md", root / "link.md")
    os.symlink(root / "b", root / "linked")
    return str(root)


def test_text_tree(spark, tree):
    found = dict(read_text_files(spark, tree, ["..Md"], ["./out/"]).collect())
    assert found == {
        "top.md": "one two", "b/10.md": "x", "b/2.md": "y y", "b/deep/1.MD": "z z z", "outer/1.md": "kept",
        "_hidden/__init__.md": "h h", "b/é %20.md": "ü",
    }
    assert len(read_text_files(spark, "file:" + tree).collect()) == 10


def test_tree_plan_does_not_grow_with_the_tree(spark, tmp_path):
    for i in range(60):
        (tmp_path / f".h{i}").mkdir()
        (tmp_path / f".h{i}" / "_x.md").write_text(str(i))
        os.symlink(tmp_path / f".h{i}", tmp_path / f"l{i}")
    frame = read_text_files(spark, str(tmp_path), ["md"])
    assert sorted(int(r.text) for r in frame.collect()) == list(range(60))
    assert len(plan_text(frame)) < 20_000


def test_only_regular_files_and_no_excluded_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    os.mkfifo(tmp_path / "pipe.txt")
    (tmp_path / "out" / "deep").mkdir(parents=True)
    os.mkfifo(tmp_path / "out" / "deep" / "pipe.txt")
    (tmp_path / "out" / "b.txt").write_text("b")
    (tmp_path / "_c").mkdir()
    (tmp_path / "_c" / "c.txt").write_text("c")
    assert {r.path for r in list_tree(spark, str(tmp_path), ["out"]).collect()} == {"a.txt", "_c/c.txt"}
    assert {r.path for r in list_tree(spark, str(tmp_path)).collect()} == {"a.txt", "out/b.txt", "_c/c.txt"}
    assert {r.text for r in read_text_files(spark, str(tmp_path), excludes=["out"]).collect()} == {"a", "c"}
    assert {r.text for r in read_text_files(spark, str(tmp_path), hidden=False).collect()} == {"a", "b"}


def test_a_root_that_hides_names_is_not_read_as_if_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "_b.txt").write_text("b")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tree.link./in", f"file://{tmp_path}")
    with pytest.raises(ValueError, match="hidden=False"):
        read_text_files(spark, "viewfs://tree/in")
    assert [tuple(r) for r in read_text_files(spark, "viewfs://tree/in", hidden=False).collect()] == [("a.txt", "a")]


def test_tasks_read_like_amounts(spark, rows):
    sizes = [1] * 300 + [40 << 20] + [1 << 20] * 100 + [0] * 50
    listed = rows([(f"f{i:04}", size) for i, size in enumerate(sizes)], "path string, size long")
    total = sum(sizes) + FILE_BYTES * len(sizes)
    packed = _packed(listed, total, 8)
    held = {r._task: (r.bytes, r.files) for r in packed.groupBy("_task").agg(F.sum("size").alias("bytes"), F.count("*").alias("files")).collect()}
    assert sum(files for _, files in held.values()) == len(sizes) and set(held) <= set(range(8))
    assert all(got <= total / 8 + (40 << 20) for got, _ in held.values())
    even = _packed(rows([(f"f{i:04}", 1 << 20) for i in range(640)], "path string, size long"), 640 * ((1 << 20) + FILE_BYTES), 8)
    assert [r["count"] for r in even.groupBy("_task").count().collect()] == [80] * 8
    placed = packed.repartitionById(8, F.col("_task")).withColumn("at", F.spark_partition_id())
    assert placed.where("at != _task").count() == 0


def test_row_ids_of_a_thousand_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(3000).select(F.col("id"), F.pmod("id", F.lit(7)).alias("n")).repartitionByRange(1000, "id").sortWithinPartitions("id").write.parquet(path)
    found = with_row_id(spark.read.parquet(path))
    plan = plan_text(found)
    assert "SinglePartition" not in plan and "Window" not in plan
    assert found.where("row_id != id").count() == 0 and found.count() == 3000
    # A join that is not broadcast gives the same.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert with_row_id(spark.read.parquet(path)).where("row_id != id").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_invalid_utf8_names_the_file(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not valid UTF-8: bad.txt"):
        read_text_files(spark, str(tmp_path)).collect()


def test_compare_text_files(spark, tree):
    sections = jobs.compare_text_files(
        spark, tree, [WORDS, Bytes()], extensions=["md"], excludes=["out"], chunk_size=2
    )
    groups = {r.group: (r["items"], r.chars, r.words, r.bytes) for r in sections["groups"].collect()}
    assert groups["b"] == (4, 10, 7, 11) and groups["top.md"] == (1, 7, 2, 7)
    chunks = [
        (r.chunk, r.first, r.last, r["items"], r.words)
        for r in sections["chunks"].where("group = 'b'").orderBy("chunk").collect()
    ]
    # The first text runs are "b/" for 2 and 10, then "b/deep/", then "b/é %".
    assert chunks == [(0, "2.md", "10.md", 2, 3), (1, "deep/1.MD", "é %20.md", 2, 4)]
    details = [r.path for r in sections["details"].collect()]
    assert details == ["_hidden/__init__.md", "b/2.md", "b/10.md", "b/deep/1.MD", "b/é %20.md", "outer/1.md", "top.md"]
    assert {r.tokenizer for r in sections["overall"].collect()} == {"words", "bytes"}
    by_parent = corpus.count_files(read_text_files(spark, tree, ["md"]), [WORDS], parent)
    assert {r.group for r in by_parent.collect()} == {".", "b", "b/deep", "out", "outer", "_hidden"}
    with pytest.raises(ValueError):
        corpus.with_chunk(by_parent, 0)


def test_count_profile_compare_tables(spark, rows, tmp_path):
    source = str(tmp_path / "set.parquet")
    data = [(f"w{'x' * i} b", "p" if i % 3 else "q") for i in range(50)]
    rows(data, "prompt string, problem_type string").coalesce(1).write.parquet(source)
    paths = [jobs.count_tables(spark, [source], "prompt", t, t.name)[0] for t in (WORDS, Chars())]
    assert paths[0] == str(tmp_path / "set.words_tokens.parquet") == counted_path(source, "words")
    stats = jobs.token_stats(spark, [paths[1], paths[1]], "chars_input_tokens")
    levels = {(r.level, r.input_id, r.group): r.total for r in stats["profile"].collect()}
    assert levels[("all", None, None)] == 100 and levels[("input_group", 1, "q")] == 17
    assert stats["histogram"].count() == len(levels) * 9
    both = TokenizerSet.of(["W=words_input_tokens", "C=chars_input_tokens"])
    sections = jobs.compare_tables(spark, {"set": paths}, both, group="problem_type")
    assert sections["by_group"].count() == 3
    fit = sections["fits"].first()
    assert fit.tokenizer == "C"
    assert {r.core for r in sections["pairs"].collect()} == {"W", "C"}
    for name, section in sections.items():
        assert section.count() > 0, name
    check = jobs.check_dataset(spark, paths[0], "words_input_tokens")
    assert [r.category for r in check["frequency"].collect()] == ["p", "q"]
    assert [r.row_id for r in check["rows"].collect()] == [0, 1, 2, 3, 4, 45, 46, 47, 48, 49]


def test_no_input_column_is_overwritten(spark, rows, tmp_path):
    frame = rows([(1, "a"), (9, "c")], "n int, band string")
    output = str(tmp_path / "s")
    write_split(frame, "n", output, 5)
    assert [tuple(r) for r in read_band(spark, output, "high").collect()] == [(9, "c")]
    for taken in ("Row_Id", "input_id", "position", "split_side"):
        table = rows([(1,)], f"{taken} int")
        with pytest.raises(ValueError, match="already has"):
            if taken == "Row_Id":
                with_row_id(table)
            elif taken == "input_id":
                tag_inputs([table])
            elif taken == "position":
                with_position(table, ["position"])
            else:
                write_split(table, taken, output)


def test_result_text_stays_on_one_line(rows):
    samples = as_samples(rows([(0, "p", ["a"], "x\ny"), (1, "p", ["a"], "y")], "row_id long, prompt string, answer_nodes array<string>, problem_type string"))
    broken = rows([(0, 200, '{"choices":[{"message":{"content":"a\\r\\nb\\rc"}}]}'), (1, 502, "<html>\r\n<body>\n")], "row_id long, status int, body string")
    found = {r["index"]: r for r in result_rows(score_responses(samples, parse_responses(broken))).collect()}
    assert found[0].response == "a b c" and found[0].problem_type == "x y"
    assert found[1].error == "status 502: <html> <body> "


def test_written_split(spark, rows, tmp_path):
    frame = rows([(1, "a"), (None, "b"), (9, "c")], "n int, x string")
    output = str(tmp_path / "s")
    assert write_split(frame, "n", output, 5) == {"low": 2, "high": 1}
    assert read_band(spark, output, "high").columns == ["n", "x"]
    assert sorted(r.x for r in read_band(spark, output, "low").collect()) == ["a", "b"]
    other = str(tmp_path / "t")
    assert write_split(frame, "n", other, 50) == {"low": 3, "high": 0}
    empty = read_band(spark, other, "high")
    assert empty.columns == ["n", "x"] and empty.count() == 0


def test_samples(spark, rows, tmp_path):
    path = str(tmp_path / "samples")
    schema = "prompt string, answer_nodes array<string>, problem_type string, n int"
    rows([("p0", ["b", "a", "b"], "x", 1), (None, None, None, None)], schema).coalesce(1).write.parquet(path)
    found = [tuple(r) for r in read_samples(spark, path, tokens="n").collect()]
    assert found == [(0, "p0", ["a", "b"], "x", 1), (1, "", [], "", None)]
    assert [tuple(r)[0] for r in read_samples(spark, path, 1).collect()] == [0]
    many = spark.range(30_000).select(F.col("id").alias("row_id"), F.lit("x").alias("problem_type")).where("row_id % 2 = 1")
    picked = first_samples(many, 12_000).agg(F.count("*"), F.max("row_id")).first()
    assert tuple(picked) == (12_000, 23_999)
    with pytest.raises(ValueError):
        as_samples(spark.read.parquet(path).drop("prompt").withColumn("row_id", F.lit(0)))


def test_result_file_text(spark, rows, tmp_path):
    samples = as_samples(
        rows([(0, "p", ["a", "b"], "x"), (1, "p", ["a"], "y")], "row_id long, prompt string, answer_nodes array<string>, problem_type string")
    )
    body = '{"choices":[{"message":{"content":"say \\"hi\\", ok\\nFinal Answer: [b, a]"}}]}'
    responses = rows([(0, 200, body), (1, 503, "busy")], "row_id long, status int, body string")
    output = str(tmp_path / "csv")
    write_results(score_responses(samples, parse_responses(responses)).coalesce(1), output)
    part = next(name for name in os.listdir(output) if name.endswith(".csv"))
    with open(os.path.join(output, part), encoding="utf-8", newline="") as source:
        header, *lines = csv.reader(source)
    assert header == (
        "index,problem_type,recall,precision,f1,error,response,reasoning_content,predicted,ground_truth,"
        "api_prompt_tokens,api_completion_tokens,api_total_tokens,api_cache_hit_tokens,api_cache_miss_tokens,"
        "api_reasoning_tokens,local_input_tokens"
    ).split(",")
    zeros = ["0"] * 6 + ["-1"]
    assert sorted(lines) == [
        ["0", "x", "1.0000", "1.0000", "1.0000", "", 'say "hi", ok Final Answer: [b, a]', "", "a;b", "a;b", *zeros],
        ["1", "y", "0.0000", "0.0000", "0.0000", "status 503: busy", "", "", "", "a", *zeros],
    ]


def test_session_settings(spark):
    session = start("tests", spark__sql__shuffle__partitions="4")
    assert session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "256"
    assert session.conf.get("spark.sql.shuffle.partitions") == "4"


def test_extensions_fold_ascii_letters_only():
    assert normal_extensions(["..MD", "tXt", "É"]) == ["md", "txt", "É"]
    assert normal_path("./a/../b//c/") == "a/b/c"


def test_materialize_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    frame = materialize(spark.range(5), "five")
    assert frame.count() == 5
    if folder:
        assert scratch_path(spark, "x").startswith(folder.rstrip("/"))


def test_materialize_leaves_no_shuffle_files(spark, shuffled):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    frame = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffled() and spark.conf.get(key, None) == before
    assert sorted(tuple(r) for r in frame.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
