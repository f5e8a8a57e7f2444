"""Which files of a corpus are scanned: skip rules by name, place and size."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is skipped by default, in the order of the kinds of place. Folders of
#: a host's own security agent and scanner are given by the caller (``agent_folders``).
SKIP_EXTENSIONS = (".iso", ".img", ".dmg", ".vmdk", ".vhd", ".vhdx", ".qcow", ".qcow2", ".sparsebundle")
SKIP_NAMES = (".ds_store", "thumbs.db", "desktop.ini")
SKIP_FRAGMENTS = ("/node_modules/", "/__pycache__/", "/.git/", "/.svn/", "/.hg/", "/.venv/", "/venv/", "/.pytest_cache/", "/.mypy_cache/", "/.gradle/", "/.yarn/cache/", "/.npm/", "/library/caches/", "/appdata/local/temp/", "/appdata/local/packages/")
FORCE_FRAGMENTS = ("/library/caches/google/chrome/", "/library/caches/chromium/", "/library/caches/microsoft edge/", "/library/caches/firefox/", "/library/caches/com.apple.safari/")
FORCE_EXCEPT = ("/volumes/", "/media/", "/mnt/", "/net/")
LINUX_SKIPS = ("/sys", "/proc", "/dev", "/run", "/tmp/.X11-unix", "/var/run", "/lost+found", "/media")
MACOS_PREFIXES = ("/system", "/private/var/folders", "/private/var/db", "/private/var/root", "/private/var/vm", "/private/var/log", "/private/tmp", "/dev", "/volumes", "/.spotlight-v100", "/.documentrevisions-v100", "/.fseventsd", "/.temporaryitems", "/.trashes", "/library/developer", "/library/caches", "/library/logs", "/applications/xcode.app/contents", "/applications/android studio.app/contents", "/applications/docker.app/contents", "/applications/vmware fusion.app/contents", "/applications/pycharm ce.app/contents", "/applications/webstorm.app/contents", "/applications/imovie.app/contents")
MACOS_APPS = (".app/contents/frameworks/", ".app/contents/resources/", ".app/contents/_codesignature/")
MACOS_FRAGMENTS = ("library/containers", "library/caches", "library/application support/google", "library/application support/jetbrains", "library/application support/code", "library/application support/slack", "library/developer", "library/android", "library/python", "library/logs", "library/metadata", "library/group containers", "pycharmprojects", "webstormprojects", "node_modules", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".gradle", ".android", ".dart_tool", "build", "dist", ".git", ".svn", ".idea", ".vscode")
WINDOWS_FOLDERS = ("c:\\programdata\\microsoft defender", "c:\\$recycle.bin", "c:\\system volume information")
DEFAULT_MAX_BYTES = 64 << 20


def parse_extra_skip(setting: str) -> list[str]:
    """Path fragments of a comma-separated setting: lower case, ``/`` throughout and at both
    ends; a lone ``/`` and repeats are left out."""
    out: dict[str, None] = {}
    for part in setting.split(","):
        inner = part.strip().lower().replace("\\", "/").strip("/")
        if inner:
            out[f"/{inner}/"] = None
    return list(out)


def _under(path: Column, folder: str, sep: str = "/") -> Column:
    """The folder itself or something below it, on a component boundary."""
    return (path == folder) | path.startswith(folder.rstrip(sep) + sep)


def _has(path: Column, fragment: str) -> Column:
    """A fragment ``/x/`` in a path, or the bare folder at its end."""
    return path.contains(fragment) | path.endswith(fragment.rstrip("/"))


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def skip_reason(path: str = "path", os_type: str = "os_type", size: str = "file_size", max_bytes: int = DEFAULT_MAX_BYTES, extra: str = "", agent_folders: tuple[str, ...] = ()) -> Column:
    """Why a file is skipped, from a fixed set of labels; null if it is scanned."""
    raw = F.col(path)
    flat = F.lower(F.translate(raw, "\\", "/"))
    name = F.element_at(F.split(flat, "/"), -1)
    forced = _any([flat.contains(f) for f in FORCE_FRAGMENTS]) & ~_any([flat.startswith(f) for f in FORCE_EXCEPT])
    fragment = _any([_has(flat, f) for f in (*SKIP_FRAGMENTS, *parse_extra_skip(extra))])
    linux = _any([_under(raw, d) for d in (*LINUX_SKIPS, *agent_folders)])
    low = F.lower(raw)
    macos = _any([_under(low, d) for d in (*MACOS_PREFIXES, *(x.lower() for x in agent_folders))]) | _any([low.contains(x) for x in MACOS_APPS]) | _any([F.concat(low, F.lit("/")).contains(f"/{f}/") for f in MACOS_FRAGMENTS]) | name.startswith("._")
    windows = _any([_under(F.lower(F.translate(raw, "/", "\\")), d, "\\") for d in (*WINDOWS_FOLDERS, *(x.lower() for x in agent_folders))])
    on = F.lower(F.col(os_type))
    placed = F.when(on == "linux", linux).when(on == "macos", macos).when(on == "windows", windows).otherwise(F.lit(False))
    big = F.col(size) > max_bytes if max_bytes else F.lit(False)
    return (
        F.when(big, "File too large")
        .when(forced, F.lit(None).cast("string"))
        .when(name.isin(*SKIP_NAMES), "Skipped file name")
        .when(_any([name.endswith(e) for e in SKIP_EXTENSIONS]), "Skipped extension")
        .when(fragment, "Skipped path")
        .when(placed, "System directory")
    )


def classify_scope(corpus: DataFrame, **options) -> DataFrame:
    """The corpus with reason and scannable."""
    return corpus.withColumn("reason", skip_reason(**options)).withColumn("scannable", F.col("reason").isNull())


def scope_filter(corpus: DataFrame, **options) -> DataFrame:
    """The files that are scanned."""
    return corpus.where(skip_reason(**options).isNull())


def dedupe_real_path(corpus: DataFrame, real_path: str = "real_path") -> DataFrame:
    """One row for each real file of a host."""
    return corpus.dropDuplicates(["hostname", real_path])


def skip_breakdown(classified: DataFrame) -> DataFrame:
    return classified.where(~F.col("scannable")).groupBy("reason").agg(F.count("*").alias("files"))


def target_coverage(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """files for each requested target (target, hostname), and a status: covered, empty
    (nothing below it), or invalid (not an absolute path).

    Files are counted by each folder above them (and as themselves), so that targets are
    looked up by equality and no file is held against every target of its host.
    """
    valid = F.col("target").rlike(r"^(/|[A-Za-z]:\\)")
    rows = targets.select("hostname", "target").distinct().withColumn("__at", F.rtrim(F.col("target"), F.lit("/\\")))

    def above(sep: str, regex: str) -> Column:
        parts = F.split("path", regex)
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))

    folders = F.explode(F.array_distinct(F.concat(above("/", "/"), above("\\", r"\\"))))
    counts = corpus.where("path is not null").select("hostname", folders.alias("__at")).groupBy("hostname", "__at").agg(F.count("*").alias("files"))
    out = rows.join(counts, ["hostname", "__at"], "left").select("hostname", "target", F.coalesce("files", F.lit(0)).cast("bigint").alias("files"))
    return out.withColumn("status", F.when(~valid, "invalid").when(F.col("files") == 0, "empty").otherwise("covered"))


def target_stats(corpus: DataFrame, target: str = "target", seconds: str = "scan_secs") -> DataFrame:
    """Files found in each target and their rate (0 where no time passed)."""
    out = corpus.groupBy("hostname", target).agg(F.count("*").alias("files_found"), F.max(seconds).alias("scan_secs"))
    return out.withColumn("files_per_second", F.coalesce(F.round(F.try_divide(F.col("files_found").cast("double"), F.col("scan_secs")), 2), F.lit(0.0)))
