"""Catalog, marks, exports, plans and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import paths as P
from lumaframe.functions import values as V
from lumaframe.operators import catalog, review, verdict
from lumaframe.plans import exports, previews
from lumaframe.queries.registry import query

NOW_S = 1_700_000_000


@query("file", r"""
    SELECT f.rel_path, regexp_extract(f.rel_path, '([^/]+)$', 1) AS name, lower(regexp_extract(f.rel_path, '(\.[^.]*)$', 1)) AS ext,
           regexp_extract(f.rel_path, '^(.*)/', 1) AS parent, CAST(length(f.rel_path) - length(replace(f.rel_path, '/', '')) + 1 AS INT) AS depth,
           CASE WHEN lower(f.rel_path) LIKE '%.mp4' OR lower(f.rel_path) LIKE '%.mov' THEN 2 ELSE 1 END AS kind,
           CASE WHEN lower(f.rel_path) LIKE '%.cr3' THEN 'magick' ELSE 'ffmpeg' END AS decoder
    FROM file f""")  # fmt: skip
def catalog_columns(v):
    files = v("file")
    rows = catalog.listed(files.select(F.col("rel_path").alias("path"), "size", "mtime"), S.formats(files.sparkSession))
    return rows.select("rel_path", "name", "ext", P.parent(F.col("rel_path")).alias("parent"), P.depth(F.col("rel_path")).alias("depth"), "kind", "decoder")


@query("folder file", """
    SELECT f.rel_path, coalesce(p.rel_path, '') AS parent, f.depth, f.name FROM folder f LEFT JOIN folder p ON p.id = f.parent_id
    WHERE f.id IN (SELECT folder_id FROM file) OR f.id IN (SELECT g.parent_id FROM folder g WHERE g.id IN (SELECT folder_id FROM file))
       OR f.id IN (SELECT h.parent_id FROM folder h JOIN folder g ON g.parent_id = h.id WHERE g.id IN (SELECT folder_id FROM file)) OR f.id = 1""")  # fmt: skip
def folder_tree(v):
    tree = catalog.folder_tree(v("file"))
    above = tree.select(F.col("id").alias("parent_id"), F.col("rel_path").alias("parent"))
    return tree.join(above, "parent_id", "left").select("rel_path", F.coalesce("parent", F.lit("")).alias("parent"), "depth", "name")


@query("file previous", """
    SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, a.id AS old_id, b.id AS new_id,
           CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS state
    FROM previous a FULL JOIN file b ON a.rel_path = b.rel_path""")  # fmt: skip
def snapshot_diff(v):
    return catalog.diff(v("previous"), v("file"))


@query("file previous", "SELECT rel_path FROM previous EXCEPT ALL SELECT rel_path FROM file")
def removed_paths(v):
    return catalog.removed(v("previous"), v("file"))


@query("file previous review", """
    SELECT r.file_id, r.decision, r.reviewer, r.updated_at FROM review r
    WHERE NOT EXISTS (SELECT 1 FROM previous p LEFT JOIN file f USING (rel_path)
                      WHERE p.id = r.file_id AND (f.id IS NULL OR f.size <> p.size OR f.mtime <> p.mtime))""")  # fmt: skip
def review_after_rescan(v):
    found = catalog.refresh(v("previous"), v("file"), v("review"), v("claim"), v("qc"), v("folder"))
    return found["reviews"].select("file_id", "decision", "reviewer", "updated_at")


@query("folder file previous review claim qc", """
    , state AS (SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS state,
                       a.id AS old_id FROM previous a FULL JOIN file b ON a.rel_path = b.rel_path),
    lost AS (SELECT old_id FROM state WHERE state IN ('changed', 'removed')),
    kept AS (SELECT f.id FROM folder f WHERE f.rel_path = '.' OR f.rel_path IN (SELECT unnest(list_transform(range(1, len(string_split(rel_path, '/'))), lambda n: array_to_string(list_slice(string_split(rel_path, '/'), 1, n), '/'))) FROM file))
    SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'changed') AS changed,
           count(*) FILTER (state = 'unchanged') AS unchanged,
           (SELECT count(*) FROM review WHERE file_id IN (SELECT old_id FROM lost)) AS marks_dropped,
           (SELECT count(*) FROM qc WHERE file_id IN (SELECT old_id FROM state WHERE state = 'removed')) AS results_dropped,
           (SELECT count(*) FROM folder WHERE id NOT IN (SELECT id FROM kept)) AS folders_pruned,
           (SELECT count(*) FROM claim WHERE folder_id NOT IN (SELECT id FROM kept)) AS claims_pruned
    FROM state""")  # fmt: skip
def refresh_counts(v):
    return catalog.refresh_counts(v("previous"), v("file"), v("review"), v("claim"), v("qc"), v("folder"))


@query("folder file claim", """
    SELECT c.folder_id, c.user_name, c.claimed_at FROM claim c JOIN folder f ON f.id = c.folder_id
    WHERE EXISTS (SELECT 1 FROM file x WHERE x.rel_path LIKE f.rel_path || '/%' AND x.folder_id % 3 <> 0)""")  # fmt: skip
def prune_claims(v):
    seen = v("file").where("folder_id % 3 <> 0").select(F.explode(P.ancestors(F.col("rel_path"))).alias("rel_path"))
    return catalog.surviving_claims(v("claim"), catalog.pruned(v("folder"), seen)).select("folder_id", "user_name", "claimed_at")


def _page(name: str, test: str):
    def f(v):
        return review.filtered(review.with_marks(v("file"), v("review"), v("qc")), name).select("id", "decision", "reviewer", "flags", "dup_hash")

    f.__name__ = f"file_page_{name}"
    query("file review qc", f"""
        SELECT f.id, coalesce(r.decision, 0) AS decision, coalesce(r.reviewer, '') AS reviewer, coalesce(q.flags, 0) AS flags, coalesce(q.dup_hash, '') AS dup_hash
        FROM file f LEFT JOIN review r ON r.file_id = f.id LEFT JOIN qc q ON q.file_id = f.id WHERE {test}""")(f)  # fmt: skip


for _name, _test in (
    ("all", "true"), ("keep", "r.decision = 1"), ("reject", "r.decision = 2"), ("pending", "coalesce(r.decision, 0) = 0"), ("image", "f.kind = 1"), ("video", "f.kind = 2"),
    ("dup", "q.flags & 1 <> 0"), ("issue", "q.flags & 510 <> 0"),
):
    _page(_name, _test)


@query("file review", """
    SELECT f.id, f.sort_key, coalesce(r.decision, 0) AS decision FROM file f LEFT JOIN review r ON r.file_id = f.id
    WHERE f.folder_id = 1001 AND (f.sort_key > 'img_1' OR (f.sort_key = 'img_1' AND f.id > 0)) ORDER BY f.sort_key, f.id LIMIT 5""")  # fmt: skip
def keyset_page(v):
    return review.page(review.with_marks(v("file"), v("review")), 1001, ("img_1", 0), 5).select("id", "sort_key", "decision")


@query("file review folder", """
    , moved AS (SELECT *, CASE WHEN id % 4 = 0 THEN (SELECT parent_id FROM folder p WHERE p.id = file.folder_id) ELSE folder_id END AS place FROM file)
    SELECT id, from_parent FROM (SELECT id, sort_key, false AS from_parent FROM moved WHERE place = 1002 ORDER BY sort_key, id LIMIT 60)
    UNION ALL
    SELECT id, from_parent FROM (SELECT id, sort_key, true AS from_parent FROM moved WHERE place = (SELECT parent_id FROM folder WHERE id = 1002) ORDER BY sort_key, id LIMIT 200)""")  # fmt: skip
def page_with_parent(v):
    folders = v("folder")
    up = folders.select(F.col("id").alias("folder_id"), "parent_id")
    files = v("file").join(up, "folder_id").withColumn("folder_id", F.when(F.col("id") % 4 == 0, F.col("parent_id")).otherwise(F.col("folder_id"))).drop("parent_id")
    return review.page_with_parent(review.with_marks(files, v("review")), folders, 1002).select("id", "from_parent")


@query("file review decision_event", """
    SELECT f.id, f.name, coalesce(r.decision, 0) AS decision FROM file f LEFT JOIN review r ON r.file_id = f.id WHERE f.id IN (SELECT file_id FROM decision_event)""")  # fmt: skip
def file_lookup(v):
    ids = v("decision_event").select(F.col("file_id").alias("id"))
    return review.lookup(review.with_marks(v("file"), v("review")), ids).select("id", "name", "decision")


@query("file", """
    SELECT 'videos' AS list, id FROM file WHERE kind = 2 UNION ALL SELECT 'folder_images', id FROM file WHERE kind = 1 AND folder_id = 1001 AND present = 1
    UNION ALL SELECT 'media', id FROM file WHERE kind IN (1, 2) AND present = 1""")  # fmt: skip
def media_lists(v):
    files = v("file")
    lists = {"videos": catalog.media_list(files, S.VIDEO, present_only=False), "folder_images": catalog.media_list(files, S.IMAGE, 1001), "media": catalog.media_list(files)}
    out = None
    for name, rows in lists.items():
        one = rows.select(F.lit(name).alias("list"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("file qc", """
    SELECT f.id FROM file f WHERE NOT EXISTS (SELECT 1 FROM qc q WHERE q.file_id = f.id AND q.size = f.size AND q.mtime = f.mtime AND q.qc_version = 5)""")  # fmt: skip
def qc_worklist(v):
    return verdict.work_list(v("file"), v("qc"), S.ALGORITHM_VERSION).select("id")


@query("qc", """
    SELECT file_id, flags & 1 <> 0 AS dup, flags & 2 <> 0 AS corrupted, flags & 4 <> 0 AS blank, flags & 8 <> 0 AS lens_dirt, flags & 16 <> 0 AS blur, flags & 32 <> 0 AS exposure,
           flags & 64 <> 0 AS noise, flags & 128 <> 0 AS shake, flags & 256 <> 0 AS ai, CAST(json_extract(detail, '$.lensDirt.boxes[0].x') AS DOUBLE) AS box_x,
           coalesce(CAST(json_extract(detail, '$.exposure.under') AS BOOLEAN), false) AS under, coalesce(CAST(json_extract(detail, '$.exposure.over') AS BOOLEAN), false) AS over
    FROM qc""")  # fmt: skip
def qc_flags_decoded(v):
    rows = verdict.decoded(v("qc"))
    return rows.withColumn("box_x", F.get("boxes", F.lit(0))["x"]).drop("boxes")


@query("qc", """
    SELECT file_id, CAST(json_extract(detail, '$.flags') AS INT) AS flags, CAST(json_extract(detail, '$.exposure.mean') AS DOUBLE) AS mean,
           json_extract(detail, '$.lensDirt') IS NOT NULL AS dirty FROM qc""")  # fmt: skip
def detail_round_trip(v):
    again = F.from_json(V.detail_json(V.parsed_detail(F.col("detail"))), S.DETAIL)
    return v("qc").select("file_id", again.alias("d")).select("file_id", "d.flags", F.col("d.exposure.mean").alias("mean"), F.col("d.lensDirt").isNotNull().alias("dirty"))


IN_SCOPE = ", scope AS (SELECT id FROM folder WHERE rel_path = 'r1' OR rel_path LIKE 'r1/%')"


def _scope(v):
    return exports.scope(v("folder"), "recursive", "r1")


@query("folder", f"{IN_SCOPE} SELECT id AS folder_id FROM scope")
def subtree_scope(v):
    return _scope(v)


@query("folder", """
    SELECT a.id AS ancestor_id, f.id AS folder_id FROM folder f JOIN folder a ON a.rel_path = '.' OR f.rel_path = a.rel_path OR f.rel_path LIKE a.rel_path || '/%'""")  # fmt: skip
def folder_closure(v):
    return catalog.closure(v("folder"))


@query("folder", """
    , up AS (SELECT id AS folder_id, id AS ancestor_id, CAST(0 AS BIGINT) AS distance FROM folder
      UNION ALL SELECT u.folder_id, f.parent_id, u.distance + 1 FROM up u JOIN folder f ON f.id = u.ancestor_id WHERE f.parent_id IN (SELECT id FROM folder))
    SELECT ancestor_id, folder_id, distance FROM up""")  # fmt: skip
def folder_closure_by_parents(v):
    return catalog.closure_by_parents(v("folder"))[0]


@query("folder", """
    , below AS (SELECT id FROM folder WHERE id = 11 UNION ALL SELECT f.id FROM below b JOIN folder f ON f.parent_id = b.id)
    SELECT id, parent_id, name, rel_path, depth FROM folder WHERE id IN (SELECT id FROM below)""")  # fmt: skip
def subtree_by_parents(v):
    return catalog.subtree_by_parents(v("folder"), 11)


@query("file review folder", f"""{IN_SCOPE}
    SELECT f.id, f.folder_id, f.sort_key FROM file f JOIN review r ON r.file_id = f.id AND r.decision = 1 WHERE f.present = 1 AND f.folder_id IN (SELECT id FROM scope)""")
def kept_set(v):
    return exports.kept(v("file"), v("review"), _scope(v)).select("id", "folder_id", "sort_key").orderBy(*exports.ORDER)


@query("file review folder", f"""{IN_SCOPE}
    SELECT file_id AS id FROM review WHERE decision = 1 INTERSECT SELECT id FROM file WHERE present = 1 AND folder_id IN (SELECT id FROM scope)""")
def kept_id_sets(v):
    return exports.kept_ids(v("file"), v("review"), _scope(v))


@query("file review folder", f"""{IN_SCOPE}
    , rows AS (SELECT f.*, coalesce(r.decision, 0) AS decision FROM file f LEFT JOIN review r ON r.file_id = f.id WHERE f.present = 1 AND f.folder_id IN (SELECT id FROM scope)),
    cents AS (SELECT *, CAST(floor(size * 100 / 1048576.0) AS BIGINT) AS w, size * 100 - CAST(floor(size * 100 / 1048576.0) AS BIGINT) * 1048576 AS rest FROM rows),
    rounded AS (SELECT *, w + CASE WHEN rest > 524288 OR (rest = 524288 AND w % 2 = 1) THEN 1 ELSE 0 END AS c FROM cents)
    SELECT row_number() OVER (ORDER BY x.folder_id, x.sort_key, x.id) AS no, d.rel_path AS folder, x.name,
           CASE x.decision WHEN 1 THEN '保留' WHEN 2 THEN '不保留' ELSE '未标记' END AS mark,
           CASE WHEN x.decision = 1 THEN CASE WHEN x.id % 3 = 0 THEN 'exists' ELSE 'copy' END ELSE '' END AS export_status,
           concat(CAST(floor(x.c / 100) AS BIGINT), '.', lpad(CAST(x.c % 100 AS VARCHAR), 2, '0')) AS size_mb
    FROM rounded x JOIN folder d ON d.id = x.folder_id""")
def manifest_rows(v):
    files, folders = v("file"), v("folder")
    there = files.where("id % 3 = 0").select("rel_path", "size")
    plan = exports.copy_plan(exports.kept(files, v("review"), _scope(v)), there)
    return exports.manifest(exports.in_scope(files, v("review"), _scope(v)), folders, plan)


@query("file review folder", f"""{IN_SCOPE}
    SELECT count(*) FILTER (WHERE r.decision = 1) AS keep, count(*) FILTER (WHERE r.decision = 2) AS reject, count(*) FILTER (WHERE coalesce(r.decision, 0) = 0) AS unmarked,
           count(*) AS total, CAST(coalesce(sum(f.size) FILTER (WHERE r.decision = 1), 0) AS BIGINT) AS kept_bytes
    FROM file f LEFT JOIN review r ON r.file_id = f.id WHERE f.present = 1 AND f.folder_id IN (SELECT id FROM scope)""")
def manifest_summary(v):
    return exports.manifest_summary(exports.in_scope(v("file"), v("review"), _scope(v)))


TEXTS = """concat_ws('、', CASE WHEN q.flags & 2 <> 0 THEN '损坏' END, CASE WHEN q.flags & 1 <> 0 THEN '重复' END, CASE WHEN q.flags & 4 <> 0 THEN '空镜' END,
    CASE WHEN q.flags & 8 <> 0 THEN '镜头脏污' END, CASE WHEN q.flags & 16 <> 0 THEN '模糊' END,
    CASE WHEN q.flags & 32 <> 0 THEN CASE WHEN json_extract_string(q.detail, '$.exposure.over') = 'true' THEN '过曝' WHEN json_extract_string(q.detail, '$.exposure.under') = 'true' THEN '欠曝' ELSE '曝光' END END,
    CASE WHEN q.flags & 64 <> 0 THEN '噪点' END, CASE WHEN q.flags & 128 <> 0 THEN '抖动' END)"""


@query("file review qc folder", f"""
    SELECT f.id, f.rel_path, f.name, CASE WHEN {TEXTS} = '' THEN '未知' ELSE {TEXTS} END AS issues, CASE r.decision WHEN 1 THEN '保留' WHEN 2 THEN '不保留' ELSE '未定' END AS mark
    FROM file f JOIN qc q ON q.file_id = f.id AND q.flags <> 0 AND q.qc_version = 5 LEFT JOIN review r ON r.file_id = f.id WHERE f.present = 1""")
def issue_report(v):
    return exports.issues(v("file"), v("qc"), v("review"), exports.scope(v("folder"), "all"), S.ALGORITHM_VERSION)


@query("file review", """
    SELECT f.rel_path, r.decision, CASE r.decision WHEN 1 THEN '保留' WHEN 2 THEN '不保留' ELSE '未定' END AS decision_text, r.reviewer,
           CASE WHEN r.updated_at > 0 THEN strftime(make_timestamp(r.updated_at * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS updated_at
    FROM review r JOIN file f ON f.id = r.file_id""")  # fmt: skip
def review_csv(v):
    return exports.review_list(v("review"), v("file"))


@query("file review folder", f"""{IN_SCOPE}
    SELECT '/media/' || f.rel_path AS path FROM file f JOIN review r ON r.file_id = f.id AND r.decision = 1 WHERE f.present = 1 AND f.folder_id IN (SELECT id FROM scope)""")
def keep_list(v):
    return exports.kept(v("file"), v("review"), _scope(v)).orderBy(*exports.ORDER).select(P.absolute("/media", F.col("rel_path")).alias("path"))


@query("file previous review", """
    , plan AS (SELECT f.id, CASE WHEN f.rel_path LIKE 'r1/%' THEN substr(f.rel_path, 4) ELSE f.rel_path END AS rel, f.size,
                      CASE WHEN p.size = f.size AND p.size > 0 THEN 'exists' ELSE 'copy' END AS status
               FROM file f LEFT JOIN (SELECT CASE WHEN rel_path LIKE 'r1/%' THEN substr(rel_path, 4) ELSE rel_path END AS rel, size FROM previous) p
                      ON p.rel = CASE WHEN f.rel_path LIKE 'r1/%' THEN substr(f.rel_path, 4) ELSE f.rel_path END)
    SELECT id, rel, size, status FROM plan""")  # fmt: skip
def copy_plan(v):
    there = v("previous").select(exports.rebased(F.col("rel_path"), "r1").alias("rel_path"), "size")
    return exports.copy_plan(v("file"), there, "r1")


@query("decision_event", """
    , steps AS (SELECT *, lag(decision) OVER (PARTITION BY file_id ORDER BY ts_ms, seq) AS before FROM decision_event),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts_ms DESC, seq DESC) AS n FROM steps WHERE before IS NULL OR before <> decision)
    SELECT file_id, decision, user_name AS reviewer, CAST(floor(ts_ms / 1000) AS BIGINT) AS updated_at FROM ranked WHERE n = 1""")  # fmt: skip
def latest_decision(v):
    return review.latest(v("decision_event"))


@query("decision_event file file_claim review", """
    SELECT CASE WHEN f.id IS NULL THEN 'missing' WHEN c.user_name IS NOT NULL AND c.user_name <> e.user_name THEN 'blocked' WHEN r.decision = e.decision THEN 'same' ELSE 'changed' END AS outcome,
           count(*) AS n
    FROM decision_event e LEFT JOIN file f ON f.id = e.file_id + CASE WHEN e.seq % 9 = 0 THEN 900000000 ELSE 0 END
    LEFT JOIN file_claim c ON c.folder_id = f.folder_id LEFT JOIN review r ON r.file_id = e.file_id + CASE WHEN e.seq % 9 = 0 THEN 900000000 ELSE 0 END GROUP BY 1""")  # fmt: skip
def decision_outcomes(v):
    edits = v("decision_event").withColumn("file_id", F.col("file_id") + F.when(F.col("seq") % 9 == 0, F.lit(900_000_000)).otherwise(F.lit(0)))
    return review.outcomes(edits, v("file"), v("file_claim"), v("review")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("file file_claim", """
    SELECT f.id, c.user_name IS NULL OR c.user_name = 'u3' AS can_edit FROM file f LEFT JOIN file_claim c ON c.folder_id = f.folder_id""")  # fmt: skip
def editable_files(v):
    return review.editable(v("file"), v("file_claim"), "u3").select("id", "can_edit")


@query("file review file_claim", f"""
    , own AS (SELECT id FROM file WHERE folder_id = 1001 AND present = 1 AND NOT EXISTS (SELECT 1 FROM file_claim WHERE folder_id = 1001 AND user_name <> 'u1'))
    SELECT file_id, decision, reviewer, updated_at FROM review WHERE file_id NOT IN (SELECT id FROM own) UNION ALL SELECT id, 1, 'u1', CAST({NOW_S} AS BIGINT) FROM own""")
def folder_decision(v):
    return review.decide_folder(v("file"), v("review"), v("file_claim"), 1001, S.KEEP, "u1", NOW_S)


@query("file review file_claim", """
    , own AS (SELECT id FROM file WHERE folder_id = 1001 AND present = 1 AND NOT EXISTS (SELECT 1 FROM file_claim WHERE folder_id = 1001 AND user_name <> 'u1'))
    SELECT file_id, decision, reviewer, updated_at FROM review WHERE file_id NOT IN (SELECT id FROM own)""")  # fmt: skip
def folder_clear(v):
    return review.clear_folder(v("file"), v("review"), v("file_claim"), 1001, "u1")


SIZE = "CAST(floor({0} * (CAST({1} AS DOUBLE) / least(w, h)) + 0.5) AS BIGINT)"


@query("probe", f"""
    , turned AS (SELECT file_id, CASE WHEN orientation BETWEEN 5 AND 8 THEN h ELSE w END AS w, CASE WHEN orientation BETWEEN 5 AND 8 THEN w ELSE h END AS h FROM probe)
    SELECT file_id, w > 0 AND h > 0 AND least(w, h) > 1600 AS need,
           CASE WHEN w > 0 AND h > 0 AND least(w, h) > 1600 THEN greatest({SIZE.format("w", 1600)}, 1) ELSE w END AS w,
           CASE WHEN w > 0 AND h > 0 AND least(w, h) > 1600 THEN greatest({SIZE.format("h", 1600)}, 1) ELSE h END AS h FROM turned""")
def preview_plan(v):
    return previews.preview_plan(v("probe"))


PLAYS = "(codec IN ('h264', 'avc1', 'vp8', 'vp9', 'av1', 'theora') AND acodec IN ('', 'aac', 'mp3', 'opus'))"


@query("probe", f"""
    SELECT file_id, {PLAYS} AS playable,
           CASE WHEN NOT {PLAYS} AND w > 0 AND h > 0 AND least(w, h) > 720 THEN greatest({SIZE.format("w", 720)} - {SIZE.format("w", 720)} % 2, 2) ELSE w END AS w,
           CASE WHEN NOT {PLAYS} AND w > 0 AND h > 0 AND least(w, h) > 720 THEN greatest({SIZE.format("h", 720)} - {SIZE.format("h", 720)} % 2, 2) ELSE h END AS h FROM probe""")
def transcode_plan(v):
    return previews.transcode_plan(v("probe"))


STATUS = f"""
    , status AS (SELECT f.id AS file_id, CASE WHEN NOT p.ok THEN 'failed' WHEN p.ok AND {PLAYS} THEN 'skipped' WHEN p.has_artifact THEN 'done' WHEN p.job IS NOT NULL THEN p.job ELSE 'pending' END AS status
                 FROM file f LEFT JOIN probe p ON p.file_id = f.id WHERE f.kind = 2)"""


def _status(v):
    probe = v("probe")
    return previews.derivative_status(catalog.media_list(v("file"), S.VIDEO, present_only=False), probe, probe.where("has_artifact"), probe.where("job is not null"))


@query("file probe", f"{STATUS} SELECT file_id, status FROM status")
def derivative_status(v):
    return _status(v)


@query("file probe", f"{STATUS} SELECT status, count(*) AS files FROM status GROUP BY status")
def transcode_tally(v):
    return previews.tally(_status(v))


@query("file probe", "SELECT f.id, CASE WHEN p.has_artifact THEN 1 ELSE f.processed END AS processed FROM file f LEFT JOIN probe p ON p.file_id = f.id")
def processed_flags(v):
    return previews.processed(v("file"), v("probe").where("has_artifact")).select("id", "processed")


@query("file", """
    SELECT id, sha1(concat_ws('|', rel_path, size, mtime, '720p')) AS cache_key,
           concat(substr(sha1(concat_ws('|', rel_path, size, mtime, '720p')), 1, 2), '/', sha1(concat_ws('|', rel_path, size, mtime, '720p')), '.mp4') AS cache_path FROM file""")  # fmt: skip
def cache_keys(v):
    return previews.cache_keys(v("file"), "720p")


@query("probe", """
    SELECT file_id, CASE WHEN w <= 0 OR h <= 0 THEN 1024 WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(CAST(floor(w * (1024.0::DOUBLE / greatest(w, h)) + 0.5) AS BIGINT), 8) END AS w,
           CASE WHEN w <= 0 OR h <= 0 THEN 1024 WHEN greatest(w, h) <= 1024 THEN h ELSE greatest(CAST(floor(h * (1024.0::DOUBLE / greatest(w, h)) + 0.5) AS BIGINT), 8) END AS h FROM probe""")  # fmt: skip
def detail_sizes(v):
    return v("probe").select("file_id", V.detail_size(F.col("w"), F.col("h")).alias("s")).select("file_id", "s.w", "s.h")


@query("", r"""
    WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) WHEN 1 THEN '../' || page_id ELSE 'a/../b/' || page_id END AS path FROM pages)
    SELECT page_id, list_contains(string_split(path, '/'), '..') AS escapes,
           CASE page_id % 4 WHEN 1 THEN '/srv' WHEN 0 THEN rtrim('/srv/' || path, '/') ELSE '/srv/b/' || page_id END AS absolute FROM p""")
def safe_paths(v):
    plain = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    path = F.when(F.col("page_id") % 4 == 0, plain).when(F.col("page_id") % 4 == 1, F.concat(F.lit("../"), "page_id")).otherwise(F.concat(F.lit("a/../b/"), "page_id"))
    return v("pages").select("page_id", P.escapes(path).alias("escapes"), P.absolute("/srv", path).alias("absolute"))


@query("", r"""
    WITH t AS (SELECT page_id, translate(url, '\/:*?"<>|', '_________') AS x, url FROM pages)
    SELECT page_id, CASE WHEN substr(trim(x), 1, 60) = '' THEN 'export' ELSE substr(trim(x), 1, 60) END AS name,
           concat(CASE WHEN page_id % 2 = 0 THEN '''=' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'x' END, url) AS cell FROM t""")
def safe_names(v):
    lead = F.when(F.col("page_id") % 2 == 0, F.lit("=")).otherwise(F.lit("x"))
    return v("pages").select("page_id", P.file_name(F.col("url")).alias("name"), P.csv_safe(F.concat(lead, "url")).alias("cell"))


@query("", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN length(trim(line)) BETWEEN 1 AND 24 AND NOT regexp_matches(trim(line), '[\x00-\x1F\x7F-\x{9F}]') THEN trim(line) END AS name FROM l""")
def reviewer_names(v):
    """Every line of every text as a name."""
    lines = v("documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", P.reviewer_name(F.col("line")).alias("name"))


@query("file", r"""
    , named AS (SELECT id, CASE id % 4 WHEN 0 THEN concat('IMG_20', lpad(CAST(id % 30 AS VARCHAR), 2, '0'), '0', CAST(id % 9 + 1 AS VARCHAR), '1', CAST(id % 9 AS VARCHAR), '-1', CAST(id % 10 AS VARCHAR), '2', CAST(id % 6 AS VARCHAR), '5', CAST(id % 7 AS VARCHAR), '.jpg')
                               WHEN 1 THEN concat('mmexport', 1600000000000 + id * 1001, '.jpg') WHEN 2 THEN concat('x', 99, 1600000000000 + id, '.jpg') ELSE name END AS n FROM file),
    parts AS (SELECT id, regexp_extract(n, '(20[0-9]{6}[_-][0-9]{6})', 1) AS d, regexp_extract(n, '(^|[^0-9])(1[0-9]{12})([^0-9]|$)', 2) AS m FROM named)
    SELECT id, CASE WHEN d <> '' THEN concat(substr(d, 1, 4), '-', substr(d, 5, 2), '-', substr(d, 7, 2), ' ', substr(d, 10, 2), ':', substr(d, 12, 2), ':', substr(d, 14, 2))
                    WHEN m <> '' AND CAST(m AS BIGINT) > 1000000000000 THEN strftime(make_timestamp(CAST(floor(CAST(m AS BIGINT) / 1000) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS shoot_key FROM parts""")
def capture_time(v):
    i = F.col("id")
    digit = lambda x: x.cast("string")
    dated = F.concat(F.lit("IMG_20"), F.lpad(digit(i % 30), 2, "0"), F.lit("0"), digit(i % 9 + 1), F.lit("1"), digit(i % 9), F.lit("-1"), digit(i % 10), F.lit("2"), digit(i % 6), F.lit("5"), digit(i % 7), F.lit(".jpg"))
    name = (
        F.when(i % 4 == 0, dated).when(i % 4 == 1, F.concat(F.lit("mmexport"), digit(F.lit(1_600_000_000_000) + i * 1001), F.lit(".jpg")))
        .when(i % 4 == 2, F.concat(F.lit("x99"), digit(F.lit(1_600_000_000_000) + i), F.lit(".jpg"))).otherwise(F.col("name"))
    )
    return v("file").select("id", V.capture_time(name).alias("shoot_key"))


@query("", """
    SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN CASE WHEN event_id % 3 = 0 THEN concat('203.0.113.', event_id % 250) WHEN event_id % 2 = 0 THEN '2001:db8::7' ELSE
           CASE event_id % 5 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '10.1.2.3' ELSE '192.168.0.9' END END ELSE concat('198.51.100.', user_id % 250) END AS ip FROM events""")  # fmt: skip
def client_ip(v):
    e, u = F.col("event_id"), F.col("user_id")
    host = F.when(e % 5 == 0, F.lit("127.0.0.1")).when(e % 5 == 1, F.lit("10.1.2.3")).when(e % 5 == 2, F.lit("192.168.0.9")).otherwise(F.concat(F.lit("198.51.100."), (u % 250).cast("string")))
    forwarded = F.when(e % 3 == 0, F.concat(F.lit(" 203.0.113."), (e % 250).cast("string"), F.lit(" , 10.0.0.1"))).otherwise(F.lit("unknown"))
    real = F.when(e % 2 == 0, F.lit("2001:db8::7"))
    return v("events").select("event_id", V.client_ip(F.concat(host, F.lit(":443")), forwarded, real).alias("ip"))


@query("claim", "SELECT folder_id, CASE WHEN claimed_at > 0 AND claimed_at < 1000000000000 THEN claimed_at * 1000 ELSE claimed_at END AS claimed_at FROM claim")
def claim_times_ms(v):
    once = V.claim_millis(F.col("claimed_at"))
    return v("claim").select("folder_id", V.claim_millis(once).alias("claimed_at"))


@query("folder file review", """
    SELECT concat(f.name, '_保留', count(*), '个.zip') AS name, CASE WHEN f.rel_path = '.' THEN '.' ELSE f.name END AS label FROM folder f JOIN file x ON x.folder_id = f.id JOIN review r ON r.file_id = x.id AND r.decision = 1
    WHERE x.present = 1 GROUP BY f.id, f.name, f.rel_path""")  # fmt: skip
def export_names(v):
    folders = v("folder")
    kept = exports.kept(v("file"), v("review"), exports.scope(folders, "all")).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    rows = kept.join(folders, kept["folder_id"] == folders["id"])
    return rows.select(P.export_name(F.col("name"), F.col("n")).alias("name"), P.root_label(F.col("rel_path")).alias("label"))
