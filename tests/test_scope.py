import pytest

from fleetscan.operators.scope import classify_scope, parse_extra_skip, target_coverage

CASES = [
    ("/proc/1/maps", "linux", "System directory"),
    ("/procs/x", "linux", None),
    ("/PROC/x", "linux", None),
    ("/opt/agent/x", "linux", "System directory"),
    ("/opt/agent2/x", "linux", None),
    ("C:\\Program Files\\Agent\\a.exe", "windows", "System directory"),
    ("C:\\Program Files\\AgentBackup\\x.log", "windows", None),
    ("D:\\System Volume Information\\x", "windows", None),
    ("/a/node_modules/b.js", "linux", "Skipped path"),
    ("/a/node_modules", "linux", "Skipped path"),
    ("/Users/u/Library/Caches/Google/Chrome/x", "macos", None),
    ("/Volumes/d/Library/Caches/Google/Chrome/x", "macos", "Skipped path"),
    ("/Users/u/._x", "macos", "System directory"),
    ("/a/x.iso", "linux", "Skipped extension"),
    ("/a/Thumbs.db", "windows", "Skipped file name"),
    ("/a/own/skip/me", "linux", "Skipped path"),
    ("/Users/u/Library/Application Support/JetBrains/x", "macos", "System directory"),
    ("/Users/u/Library/Application Support/Slack/x", "macos", "System directory"),
    ("/Users/u/PycharmProjects/a.py", "macos", "System directory"),
    ("/Applications/Docker.app/Contents/MacOS/d", "macos", "System directory"),
    ("/Applications/Docker2.app/Contents/MacOS/d", "macos", None),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_skip_reasons(spark, at):
    path, os_type, want = CASES[at]
    df = spark.createDataFrame([(path, os_type, 1)], "path string, os_type string, file_size bigint")
    row = classify_scope(df, agent_folders=("/opt/agent", "c:\\program files\\agent"), extra="Own\\Skip").first()
    assert row["reason"] == want and row["scannable"] == (want is None)


def test_size_cap_and_settings(spark):
    df = spark.createDataFrame([("/a", "linux", 11)], "path string, os_type string, file_size bigint")
    assert classify_scope(df, max_bytes=10).first()["reason"] == "File too large"
    assert classify_scope(df, max_bytes=0).first()["scannable"]
    assert parse_extra_skip("A\\b, /, /c/,,a/B") == ["/a/b/", "/c/"]


def test_targets_without_files_show(spark):
    t = spark.createDataFrame([("h", "/a"), ("h", "/b"), ("h", "c")], "hostname string, target string")
    c = spark.createDataFrame([("h", "/a/x"), ("h", "/ab/x")], "hostname string, path string")
    got = {r["target"]: (r["files"], r["status"]) for r in target_coverage(t, c).collect()}
    assert got == {"/a": (1, "covered"), "/b": (0, "empty"), "c": (0, "invalid")}
    t = spark.createDataFrame([("h", x) for x in ("/", "C:\\", "C:\\a", "/a/", "/a/x", "/a")], "hostname string, target string")
    c = spark.createDataFrame([("h", x) for x in ("/a/x", "/a/b/y", "C:\\a\\b.exe", "C:\\ab")] + [("i", "/a/q")], "hostname string, path string")
    got = {r["target"]: r["files"] for r in target_coverage(t, c).collect()}
    assert got == {"/": 2, "C:\\": 2, "C:\\a": 1, "/a/": 2, "/a/x": 1, "/a": 2}
