"""The log pipeline, on tables and on streams."""

from __future__ import annotations

from datetime import datetime

import pytest

from checks import layout
from evenkeel.operators.runs import (
    label_runs,
    missing_results,
    parse_results,
    result_lines,
    run_summary,
    summary_listing,
    throughput,
    write_summary,
    write_summary_text,
)
from evenkeel.sources import read_logs
from evenkeel.streaming.summary import follow_logs, follow_summary

SF = "/root/testdata/sf0.01"
LINE = "Vuser 1:TEST RESULT : System achieved {} NOPM from {} PostgreSQL TPM"


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    files = {
        "tpcc.PG-17.2.1.log": ["Vuser 2:noise", LINE.format(42332, 97427), "the end"],
        "tpcc.PG-17.2.2.log": ["Vuser 2:noise"],
        "tpcc.PG-17.2-some_lib.1.log": [LINE.format(38385, 88486)],
        "tpcc.PG-17.2-some_lib.10.log": ["TEST RESULT : cut off"],
        "tpcc.PG-17.2-some_lib.2.log": [LINE.format(37331, 86015), LINE.format(1, 2)],
        "tpcc.cleanup.PG-17.2.1.log": [LINE.format(9, 9)],
        "tpcc.maintenance.PG-17.2.1.log": [LINE.format(9, 9)],
        "tpcc.summary.PG-17.2.log": [LINE.format(9, 9)],
        "tpcc.PG-17.2.prepare.log": [LINE.format(9, 9)],
    }
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return folder


WANT = [
    ("tpcc", "PG-17.2", 1, 1, 42332, 97427, "PostgreSQL"),
    ("tpcc", "PG-17.2-some_lib", 1, 1, 38385, 88486, "PostgreSQL"),
    ("tpcc", "PG-17.2-some_lib", 2, 1, 37331, 86015, "PostgreSQL"),
    ("tpcc", "PG-17.2-some_lib", 2, 1, 1, 2, "PostgreSQL"),
    ("tpcc", "PG-17.2-some_lib", 10, None, None, None, None),
]


def test_summary_of_files(spark, logs):
    rows = run_summary(read_logs(spark, f"{logs}/*.log")).collect()
    assert [tuple(r)[:7] for r in rows] == WANT
    assert rows[-1].value == "TEST RESULT : cut off"


def test_listing_has_a_header_per_variant(spark, logs):
    listing = summary_listing(run_summary(read_logs(spark, str(logs)))).collect()
    values = [r.value for r in listing]
    assert values[0] == "tpcc.summary.PG-17.2.log" and values[1] == LINE.format(42332, 97427)
    assert values[2] == "tpcc.summary.PG-17.2-some_lib.log" and len(values) == len(WANT) + 2
    assert values[-1] == "TEST RESULT : cut off"


def test_runs_without_result(spark, logs):
    missing = missing_results(read_logs(spark, str(logs))).collect()
    assert [tuple(r) for r in missing] == [("tpcc", "PG-17.2", 2)]


def test_mark_is_plain_text(spark):
    lines = spark.createDataFrame(
        [("TEST RESULT :",), ("TEST RESULT:",), ("TEST.RESULT :",), (None,)], "value string"
    )
    assert result_lines(lines).count() == 1
    assert parse_results(result_lines(lines)).head().nopm is None


def test_numbers_too_large_are_null(spark):
    logs = spark.createDataFrame(
        [(f"tpcc.PG-17.{n}.log", LINE.format(10**30, 7)) for n in (99999999999, 10**30)], "file_name string, value string"
    )
    rows = {(r.variant, r.iteration, r.nopm, r.tpm) for r in run_summary(logs).collect()}
    assert rows == {("PG-17", 99999999999, None, 7), ("PG-17", None, None, 7)}
    assert label_runs(logs).filter("iteration = 1").count() == 0


def test_summary_is_replaced_or_grows(spark, logs, tmp_path):
    summary = run_summary(read_logs(spark, str(logs)))
    path = str(tmp_path / "summary")
    for append, times in [(False, 1), (True, 2), (False, 1)]:
        write_summary(summary, path, append)
        stored = spark.read.parquet(path)
        assert stored.count() == len(WANT) * times
    assert {r.variant for r in stored.collect()} == {"PG-17.2", "PG-17.2-some_lib"}
    write_summary_text(summary, str(tmp_path / "text"))
    lines = spark.read.text(str(tmp_path / "text"))
    assert lines.filter("variant = 'PG-17.2'").head().value == LINE.format(42332, 97427)


def test_stream_gives_the_same_summary(spark, logs, tmp_path):
    path, checkpoint = str(tmp_path / "summary"), str(tmp_path / "checkpoint")

    def catch_up():
        query = follow_summary(follow_logs(spark, str(logs)), path, checkpoint, True)
        assert query.awaitTermination(120)
        return spark.read.parquet(path)

    assert catch_up().count() == len(WANT)
    assert catch_up().count() == len(WANT)
    (logs / "tpcc.PG-17.2.3.log").write_text(LINE.format(5, 6) + "\n")
    stored = catch_up()
    assert stored.count() == len(WANT) + 1
    third = stored.filter("iteration = 3").head()
    assert (third.benchmark, third.variant, third.nopm, third.tpm) == ("tpcc", "PG-17.2", 5, 6)


def test_labels_of_a_stream_and_a_table_agree(spark, logs):
    table = label_runs(read_logs(spark, str(logs)))
    stream = label_runs(follow_logs(spark, str(logs)))
    assert stream.isStreaming and stream.schema.names == table.schema.names


def test_throughput_window(spark):
    events = spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, m), t) for m, t in
         [(0, "order"), (1, "order"), (2, "view"), (3, "order"), (4, "view"), (5, "order")]],
        "ts timestamp, event_type string",
    )
    row = throughput(events, 1, 4, "order").head()
    assert tuple(row) == (4, 2, 1.0, 0.5)
    later = throughput(events, 1, 4, "order", start=datetime(2024, 1, 1, 0, 1)).head()
    assert (later.total_events, later.order_events) == (4, 2)
    with pytest.raises(ValueError, match="duration"):
        throughput(events, 1, 0, "order")


def test_known_start_reaches_the_scan(spark, capsys):
    events = layout.table(spark, SF, "events")
    throughput(events, 0, 60, "purchase", start=datetime(2024, 1, 2)).explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in plan and "LessThan(ts," in plan
