"""Counts, roll-ups, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe.functions import values as V
from lumaframe.operators import stats
from lumaframe.queries import library
from lumaframe.queries.registry import SQL, query

NOW_MS = 1_706_600_000_000

OWN = """
    , own AS (SELECT d.id AS folder_id, count(f.id) AS total, count(*) FILTER (WHERE r.decision = 1) AS keep, count(*) FILTER (WHERE r.decision = 2) AS reject
              FROM folder d LEFT JOIN file f ON f.folder_id = d.id LEFT JOIN review r ON r.file_id = f.id GROUP BY d.id)"""
TREE = f"""{OWN}
    , tree AS (SELECT a.id, a.parent_id, a.name, a.rel_path, a.depth, CAST(sum(o.total) AS BIGINT) AS total, CAST(sum(o.keep) AS BIGINT) AS keep, CAST(sum(o.reject) AS BIGINT) AS reject
               FROM folder a JOIN folder f ON a.rel_path = '.' OR f.rel_path = a.rel_path OR f.rel_path LIKE a.rel_path || '/%' JOIN own o ON o.folder_id = f.id
               GROUP BY a.id, a.parent_id, a.name, a.rel_path, a.depth)"""


def _own(v):
    return stats.folder_counts(v("folder"), v("file"), v("review"))


def _tree(v):
    return stats.tree_counts(v("folder"), _own(v))


@query("folder file review", f"{OWN} SELECT folder_id, total, keep, reject FROM own")
def folder_stats(v):
    return _own(v)


@query("folder file review", f"""{TREE}
    SELECT id, parent_id, name, rel_path, depth, total, keep, reject, total - keep - reject AS pending, EXISTS (SELECT 1 FROM folder c WHERE c.parent_id = tree.id) AS has_children FROM tree""")
def tree_rollup(v):
    return _tree(v)


@query("folder file review", f"""{TREE}
    SELECT id, rel_path, total, keep, reject, total - keep - reject AS pending FROM tree ORDER BY total - keep - reject DESC, total DESC, id LIMIT 8""")
def most_pending_subtrees(v):
    """Which subtrees have most undecided files: catalog join, counts, roll-up, top-k."""
    return _tree(v).select("id", "rel_path", "total", "keep", "reject", "pending").orderBy(F.desc("pending"), F.desc("total"), "id").limit(8)


@query("folder file review", f"""{OWN}
    , parts AS (SELECT string_split(f.rel_path, '/')[1] AS level1, string_split(f.rel_path, '/')[2] AS level2, o.* FROM folder f JOIN own o ON o.folder_id = f.id)
    SELECT level1, level2, CAST(sum(total) AS BIGINT) AS total, CAST(sum(keep) AS BIGINT) AS keep, CAST(sum(reject) AS BIGINT) AS reject, CAST(grouping(level1, level2) AS INT) AS grouping FROM parts GROUP BY ROLLUP (level1, level2)""")
def level_rollup(v):
    return stats.level_counts(v("folder"), _own(v))


@query("folder file review claim", f"""{TREE}
    SELECT t.id, t.name, t.total, c.user_name AS claimed_by FROM tree t LEFT JOIN claim c ON c.folder_id = t.id WHERE t.parent_id = 11""")
def subfolders(v):
    return stats.subfolders(_tree(v), 11, v("claim")).select("id", "name", "total", "claimed_by")


PROGRESS = """
    , progress AS (SELECT f.folder_id, count(*) AS total, count(*) FILTER (WHERE coalesce(r.decision, 0) <> 0) AS done FROM file f LEFT JOIN review r ON r.file_id = f.id WHERE f.present = 1 GROUP BY f.folder_id)"""


@query("file review file_claim", f"""{PROGRESS}
    SELECT p.folder_id, p.total, p.done, p.total - p.done AS pending, c.user_name AS claimer FROM progress p LEFT JOIN file_claim c ON c.folder_id = p.folder_id
    WHERE p.total > p.done ORDER BY p.total - p.done DESC, p.total DESC, p.folder_id LIMIT 8""")
def folder_progress_top8(v):
    return stats.most_pending(stats.folder_progress(v("file"), v("review"), v("file_claim")))


@query("file review", """
    SELECT files, keep, reject, files - keep - reject AS pending FROM (SELECT count(*) AS files FROM file) f, (SELECT count(*) FILTER (WHERE decision = 1) AS keep, count(*) FILTER (WHERE decision = 2) AS reject FROM review) r""")  # fmt: skip
def totals(v):
    return stats.totals(v("file"), v("review"))


@query("file", """
    SELECT count(*) FILTER (WHERE kind = 1) AS photos, count(*) FILTER (WHERE kind = 2) AS videos, count(*) FILTER (WHERE processed = 1) AS processed, count(*) FILTER (WHERE processed = 0) AS unprocessed
    FROM file WHERE present = 1""")  # fmt: skip
def media_totals(v):
    return stats.media_totals(v("file"))


BITS = ", ".join(f"count(*) FILTER (WHERE q.flags & {bit} <> 0) AS {name}" for name, bit in stats.BITS.items())


@query("file qc", f"SELECT f.folder_id, count(*) AS total, {BITS} FROM file f JOIN qc q ON q.file_id = f.id WHERE f.present = 1 GROUP BY f.folder_id")
def qc_counts_folder(v):
    return stats.qc_counts(v("file"), v("qc"), by_folder=True)


@query("file qc", f"SELECT count(*) AS total, {BITS} FROM file f JOIN qc q ON q.file_id = f.id WHERE f.present = 1")
def qc_counts_all(v):
    return stats.qc_counts(v("file"), v("qc"))


@query("file review", """
    SELECT f.folder_id, count(*) AS marked, count(*) FILTER (WHERE r.reviewer = 'rev3') AS mine FROM review r JOIN file f ON f.id = r.file_id WHERE f.present = 1 GROUP BY f.folder_id""")  # fmt: skip
def mark_counts(v):
    return stats.mark_counts(v("file"), v("review"), "rev3")


@query("file review", """
    SELECT f.folder_id, count(*) AS files, count(*) FILTER (WHERE r.decision IN (1, 2)) AS done FROM file f LEFT JOIN review r ON r.file_id = f.id WHERE f.present = 1 GROUP BY f.folder_id""")  # fmt: skip
def done_counts(v):
    return stats.done_counts(v("file"), v("review"))


MS = "CASE WHEN claimed_at < 1000000000000 THEN claimed_at * 1000 ELSE claimed_at END"


def _claims(v):
    return v("claim").withColumn("claimed_at", V.claim_millis(F.col("claimed_at")))


@query("folder claim", f"""
    SELECT folders, claims, stale, claims - stale AS active, folders - (claims - stale) AS unclaimed
    FROM (SELECT count(*) AS folders FROM folder) f, (SELECT count(*) AS claims, count(*) FILTER (WHERE {MS} < {NOW_MS - 1800000}) AS stale FROM claim) c""")
def claim_summary(v):
    return stats.claim_summary(v("folder"), _claims(v), NOW_MS)


@query("folder claim", f"""
    SELECT c.folder_id, f.name, f.rel_path, c.user_name, {MS} AS claimed_at, {NOW_MS - 1800000} - {MS} AS idle_ms FROM claim c JOIN folder f ON f.id = c.folder_id
    WHERE {MS} < {NOW_MS - 1800000} ORDER BY {MS}, c.folder_id LIMIT 100""")
def stale_claims(v):
    return stats.stale_claims(_claims(v), v("folder"), NOW_MS)


@query("claim known_user", f"""
    SELECT name, min(folder_id) AS folder_id FROM (SELECT user_name AS name, folder_id FROM claim UNION ALL SELECT name, NULL FROM known_user WHERE last_used >= {NOW_MS - 300000}) x
    WHERE trim(name) <> '' AND name <> '匿名' GROUP BY name""")
def active_reviewers(v):
    return stats.active_reviewers(v("claim"), v("known_user"), NOW_MS)


@query("feed", """
    SELECT trim(user_name) AS name, max(ts_ms) AS last_used FROM feed WHERE trim(user_name) NOT IN ('', '匿名')
    GROUP BY trim(user_name) ORDER BY max(ts_ms) DESC, min(event_id) DESC LIMIT 20""")  # fmt: skip
def recent_names(v):
    return stats.recent_names(v("feed").select(F.col("user_name").alias("name"), F.col("ts_ms").alias("last_used"), F.col("event_id").alias("seq")))


@query("file qc probe feed", """
    SELECT 'failed' AS kind, f.rel_path AS text, CAST(1 AS BIGINT) AS n FROM file f JOIN probe p ON p.file_id = f.id WHERE f.kind = 2 AND NOT p.ok
    UNION ALL SELECT 'missing', rel_path, 1 FROM (SELECT rel_path FROM file WHERE present = 0 ORDER BY name, id LIMIT 200)
    UNION ALL SELECT 'missing_more', '', n - 200 FROM (SELECT count(*) AS n FROM file WHERE present = 0) WHERE n > 200
    UNION ALL SELECT 'scan', props, 1 FROM feed WHERE event_type = 'error'
    UNION ALL SELECT 'corrupted', '', n FROM (SELECT count(*) AS n FROM qc WHERE flags & 2 <> 0) WHERE n > 0""")  # fmt: skip
def issue_centre(v):
    files = v("file")
    failed = files.where("kind = 2").join(v("probe").where("not ok").select(F.col("file_id").alias("id")), "id", "left_semi")
    errors = v("feed").where("event_type = 'error'").select(F.col("props").alias("message"))
    return stats.issue_centre(files, failed, v("qc"), errors)


def _section(name: str, columns: str, sql: str) -> str:
    """A section of the dashboard in DuckDB: the rows of some SQL as one JSON array."""
    fields = ", ".join(f"{c} := x.{c}" for c in columns.split())
    return f"SELECT '{name}' AS section, '[' || coalesce(string_agg(j, ',' ORDER BY j), '') || ']' AS json FROM (SELECT CAST(to_json(struct_pack({fields})) AS VARCHAR) AS j FROM ({sql}) x)"


FOLDERS, WORKERS, ISSUES, TALLY = "folder_id total done pending claimer", "active reviewing", "kind n", "status files"


@query("", " UNION ALL ".join([
    _section("claims", "folders claims stale active unclaimed", SQL["claim_summary"]),
    _section("folders", FOLDERS, f"SELECT folder_id, total, done, pending, coalesce(claimer, '') AS claimer FROM ({SQL['folder_progress_top8']})"),
    _section("issues", ISSUES, f"SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM ({SQL['issue_centre']}) GROUP BY kind"),
    _section("media", "photos videos processed unprocessed", SQL["media_totals"]),
    _section("qc", "total " + " ".join(stats.BITS), SQL["qc_counts_all"]),
    _section("totals", "files keep reject pending", SQL["totals"]),
    _section("transcodes", TALLY, SQL["transcode_tally"]),
    _section("workers", WORKERS, f"SELECT count(*) AS active, count(folder_id) AS reviewing FROM ({SQL['active_reviewers']})"),
]))
def dashboard_snapshot(v):
    """All sections: counts, and the eight folders with most to do. Rows of issues are issue_centre's; here they are counted by kind."""
    people = active_reviewers(v).agg(F.count(F.lit(1)).alias("active"), F.count("folder_id").alias("reviewing"))
    return stats.dashboard({
        "claims": claim_summary(v), "folders": folder_progress_top8(v).select(*FOLDERS.split()[:-1], F.coalesce("claimer", F.lit("")).alias("claimer")),
        "issues": issue_centre(v).groupBy("kind").agg(F.sum("n").alias("n")), "media": media_totals(v), "qc": qc_counts_all(v), "totals": totals(v),
        "transcodes": library.transcode_tally(v), "workers": people.select(*WORKERS.split()),
    })
