from datetime import datetime

from pageloom.operators import incremental as I

RUNS = "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
FILES = "id long, path string, mtime double, indexed_at string, lang string, kind string"
EVENTS = "event_id long, ts timestamp_ntz, kind string, path string, mtime double, id string"


def at(day, hour=0):
    return datetime(2026, 1, day, hour)


def tables(spark, files, events):
    runs = [(1, at(1, 2), at(1, 4), "ok"), (2, at(8, 2), at(8, 4), "failed"), (3, at(9, 2), None, "failed"), (4, at(10, 23), at(11, 1), "ok"), (5, None, None, None)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(events, EVENTS)


def found(spark, files, events):
    f, r, e = tables(spark, files, events)
    return sorted(x[0] for x in I.files_to_process(f, r, e).collect())


def test_states(spark):
    files = [
        (1, "/same.jpg", 5.0, "2026-01-01T03:00:00Z", None, "x"),
        (1, "/same.jpg", 5.0, "2026-01-01T03:00:00Z", None, "x"),  # repeated
        (2, "/changed.PNG", 5.0, "2026-01-01T05:00:00+02:00", None, None),
        (3, "/failed.jpg", 6.0, "2026-01-08T03:00:00Z", None, None),  # stored by a failed run
        (4, "/later.gif", 1.0, "2026-01-01T03:00:00Z", None, None),
        (4, "/later.gif", 2.0, "2026-01-11T00:30:00.5Z", None, None),  # over midnight, latest counts
        (5, "/gone.jpg", 5.0, "2026-01-01T03:00:00Z", None, None),
        (6, None, 5.0, "2026-01-01T03:00:00Z", None, None),
        (7, "/bad.jpg", 5.0, "yesterday", None, None),
    ]
    e = lambda k, p, m, d, kind="modify": (k, at(d), kind, p, m, "z")
    events = [
        e(1, "/same.jpg", 4.0, 1), e(2, "/same.jpg", 5.0, 2), e(3, "/same.jpg", 9.0, 3, "access"), e(4, "/changed.PNG", 5.5, 2), e(5, "/failed.jpg", 6.0, 2),
        e(6, "/later.gif", 2.0, 2), e(7, "/gone.jpg", 7.0, 2), e(8, "/gone.jpg", None, 3, "remove"), e(9, "/new.webp", 1.0, 2), e(9, "/new.webp", 1.0, 2),
        e(10, "/notes.txt", 1.0, 2), e(11, None, 1.0, 2), e(12, "/bad.jpg", 5.0, 2), e(13, "/null.jpg", None, 2), e(14, "/late.jpg", 3.0, 5), e(15, "/late.jpg", 1.0, 4),
        e(16, "/.jpg", 1.0, 2),
    ]
    assert found(spark, files, events) == ["/bad.jpg", "/changed.PNG", "/failed.jpg", "/late.jpg", "/new.webp", "/null.jpg"]


def test_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [(1, at(1), "create", "/a.jpg", 1.0, None)]) == ["/a.jpg"]


def test_reread_position(spark):
    _, r, _ = tables(spark, [], [])
    assert I.reread_position(r).first()[0] == at(8, 2)
    assert I.reread_position(r.limit(0)).first()[0] is None
    assert I.reread_position(r.filter("run_id = 1")).first()[0] == at(1, 2)


def test_ledger_survives_failures(spark, tmp_path):
    ledger = I.Ledger(spark, f"file://{tmp_path}/ledger", "path", "mtime")
    now = spark.createDataFrame([("/a", 1.0), ("/b", 1.0), ("/n", None)], "path string, mtime double")
    assert ledger.pending(now).count() == 3
    # a run that died before its commit leaves no trace
    assert ledger.commit(now.filter("path = '/a'"), "run-1") and not ledger.commit(now, "run-1")
    assert sorted(r.path for r in ledger.pending(now).collect()) == ["/b", "/n"]
    changed = spark.createDataFrame([("/a", 2.0), ("/b", 1.0)], "path string, mtime double")
    assert sorted(r.path for r in ledger.pending(changed).collect()) == ["/a", "/b"]
    assert ledger.commit(changed, "run-2") and ledger.pending(changed).isEmpty()
    assert ledger.runs() == ["run-1", "run-2"]


def test_ledger_keeps_the_latest_version(spark, tmp_path):
    ledger = I.Ledger(spark, f"file://{tmp_path}/ledger", "path", "mtime")
    df = lambda rows: spark.createDataFrame(rows, "path string, mtime double")
    ledger.commit(df([("/a", 1.0), ("/b", 1.0)]), "r1")
    ledger.commit(df([("/a", 2.0)]), "r2")
    assert [r.path for r in ledger.pending(df([("/a", 1.0), ("/b", 1.0)])).collect()] == ["/a"]  # back to its first version
    ledger.commit(df([]), "r3", removed=df([("/b", 1.0)]).select("path"))
    back = df([("/a", 2.0), ("/b", 1.0)])
    assert [r.path for r in ledger.pending(back).collect()] == ["/b"]  # removed and restored
    ledger.compact(back)
    assert [r.path for r in ledger.pending(back).collect()] == ["/b"] and ledger.runs() == ["r1", "r2", "r3"]
    assert not ledger.commit(back, "r2") and ledger.commit(back, "r4")
    ledger.compact(back)
    assert ledger.pending(back).isEmpty() and ledger.runs() == ["r1", "r2", "r3", "r4"]


def test_reread_and_state(spark, tmp_path):
    ledger, state = I.Ledger(spark, f"file://{tmp_path}/ledger", "path", "mtime"), I.DiskState(spark, f"file://{tmp_path}/state")
    rows = [(1, at(1), "create", "/a.jpg", 1.0, ""), (2, at(2), "create", "/b.jpg", 1.0, ""), (3, at(5), "modify", "/a.jpg", 3.0, ""), (4, at(3), "modify", "/a.jpg", 2.0, ""),
            (5, at(6), "remove", "/b.jpg", None, ""), (6, at(4), "create", "/c.jpg", 1.0, ""), (6, at(4), "create", "/c.jpg", 1.0, ""), (7, at(7), "access", "/b.jpg", None, ""), (8, at(8), "create", None, 1.0, "")]
    log = spark.createDataFrame(rows, EVENTS)
    assert ledger.reread_from() is None
    done = []
    for run, upto, ok in (("r1", 2, True), ("r2", 3, False), ("r3", 4, True), ("r4", 8, True)):
        now = state.advance(log.filter(f"event_id <= {upto}"), ledger.reread_from())
        ledger.begin(run, upto)
        todo = ledger.pending(now)
        if ok:
            done.append(sorted((r.path, r.mtime) for r in todo.collect()))
            ledger.commit(todo, run)
    assert done == [[("/a.jpg", 1.0), ("/b.jpg", 1.0)], [("/a.jpg", 3.0)], [("/c.jpg", 1.0)]]
    assert ledger.reread_from() == 3  # r2 never ended
    whole = sorted(map(tuple, I.disk_state(log.filter(I.is_image(log.path))).collect()))
    assert sorted(map(tuple, state.advance(log, ledger.reread_from()).collect())) == whole == [("/a.jpg", 3.0), ("/c.jpg", 1.0)]
