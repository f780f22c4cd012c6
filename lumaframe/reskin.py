"""The driver's tables seen as a media library, stated once in SQL that Spark and DuckDB both run.

Only functions that both have are used; the few that differ are filled in per dialect. Each view grows with the tables
that it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {"ms": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)", "stamp": "CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {0}) AS STRING)"},
    "duckdb": {"ms": "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)", "stamp": "strftime(make_timestamp(CAST({0} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"},
}

#: name -> (views and tables it reads, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "folder": (
        "region nation customer",
        """
        SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS parent_id, '.' AS name, '.' AS rel_path, 1 AS depth
        UNION ALL SELECT CAST(10 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), concat('r', r_regionkey), concat('r', r_regionkey), 1 FROM region
        UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(10 + n_regionkey AS BIGINT), concat('N', n_nationkey),
                         concat('r', n_regionkey, '/N', n_nationkey), 2 FROM nation
        UNION ALL SELECT 1000 + c_custkey, CAST(100 + c_nationkey AS BIGINT), concat('c', c_custkey),
                         concat('r', n_regionkey, '/N', n_nationkey, '/c', c_custkey), 3
                  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "media": (
        "folder orders",
        """
        SELECT k + 1 AS id, folder_id, name, lower(name) AS sort_key, concat(rel, '/', name) AS rel_path, ext, size, 1500000000 + k * 13 AS mtime,
               CASE WHEN ext IN ('.mp4', '.mov') THEN 2 ELSE 1 END AS kind, CASE WHEN k % 50 = 0 THEN 0 ELSE 1 END AS present,
               CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS processed, k
        FROM (SELECT o_orderkey AS k, f.id AS folder_id, f.rel_path AS rel, CAST(round(o_totalprice * 100) AS BIGINT) AS size,
                     concat(CASE o_orderkey % 3 WHEN 0 THEN 'IMG_' WHEN 1 THEN 'img_' ELSE 'Dsc_' END, o_orderkey % 100, '_', o_orderkey,
                            CASE o_orderkey % 10 WHEN 6 THEN '.PNG' WHEN 7 THEN '.mp4' WHEN 8 THEN '.MOV' WHEN 9 THEN '.cr3' ELSE '.jpg' END) AS name,
                     CASE o_orderkey % 10 WHEN 6 THEN '.png' WHEN 7 THEN '.mp4' WHEN 8 THEN '.mov' WHEN 9 THEN '.cr3' ELSE '.jpg' END AS ext
              FROM orders JOIN folder f ON f.id = 1000 + o_custkey) o""",
    ),
    "file": ("media", "SELECT id, folder_id, name, sort_key, rel_path, ext, size, mtime, kind, present, processed FROM media"),
    "previous": (
        "media",
        """
        SELECT id, folder_id, name, sort_key, rel_path, ext, CASE WHEN k % 13 = 0 THEN size + 1 ELSE size END AS size,
               CASE WHEN k % 19 = 0 THEN mtime - 5 ELSE mtime END AS mtime, kind, present, processed
        FROM media WHERE k % 17 <> 0
        UNION ALL
        SELECT id + 1000000000, folder_id, concat('gone_', name), concat('gone_', sort_key), concat('old/', name), ext, size, mtime, kind, present, processed
        FROM media WHERE k % 41 = 0""",
    ),
    "review": (
        "orders",
        """
        SELECT o_orderkey + 1 AS file_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS decision,
               concat('rev', o_orderkey % 7) AS reviewer, CASE WHEN o_orderkey % 97 = 0 THEN CAST(0 AS BIGINT) ELSE 1600000000 + o_orderkey END AS updated_at
        FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 1""",
    ),
    "qc_base": (
        "documents",
        """
        SELECT doc_id AS k, doc_id + 1 AS file_id, CAST(floor(doc_id / 20) AS BIGINT) AS i,
               CASE WHEN doc_id % 8 = 0 THEN '' ELSE source END AS device, text,
               (CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 23 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 0 END
                + CASE WHEN doc_id % 11 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 15 = 0 THEN 16 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 32 ELSE 0 END
                + CASE WHEN doc_id % 13 = 0 THEN 64 ELSE 0 END + CASE WHEN doc_id % 17 = 0 THEN 128 ELSE 0 END + CASE WHEN doc_id % 19 = 0 THEN 256 ELSE 0 END) AS flags
        FROM documents""",
    ),
    "qc": (
        "qc_base media",
        """
        SELECT b.file_id, b.flags,
               concat('{"flags":', b.flags, ',"dupHash":"x"',
                      CASE WHEN b.k % 6 = 0 THEN concat(',"exposure":{"under":', CASE WHEN b.k % 4 = 0 THEN 'true' ELSE 'false' END, ',"over":',
                                                        CASE WHEN b.k % 9 = 0 THEN 'true' ELSE 'false' END, ',"mean":', b.k % 256, '.5}') ELSE '' END,
                      CASE WHEN b.k % 11 = 0 OR b.k % 10 = 3 THEN concat(',"lensDirt":{"conf":0.125,"boxes":[{"x":', (b.k % 6) * 0.125, ',"y":', (b.i % 6) * 0.125,
                                                        ',"w":0.25,"h":0.25}]}') ELSE '' END, '}') AS detail,
               CASE WHEN b.k % 47 = 0 THEN '' WHEN b.k % 2 = 0 THEN substr(md5(b.text), 1, 16)
                    ELSE concat(substr(md5(concat(b.device, '-', CAST(floor(b.i / 3) AS BIGINT))), 1, 15), b.i % 3) END AS dup_hash,
               b.device, CASE WHEN b.k % 53 = 0 THEN '' ELSE {stamp} END AS shoot_key,
               CASE WHEN b.k % 9 = 0 THEN m.size + 1 ELSE m.size END AS size, m.mtime, CASE WHEN b.k % 10 = 3 THEN 4 ELSE 5 END AS qc_version,
               1600000000 + b.k AS updated_at
        FROM qc_base b JOIN media m ON m.id = b.file_id""",
    ),
    "feed": (
        "events",
        "SELECT event_id, {ms} AS ts_ms, ts, concat('u', user_id) AS user_name, user_id, event_type, value, props FROM events",
    ),
    "claim_event": ("feed", """
        SELECT ts_ms, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 100 + event_id % 25 ELSE 1000 + 10 * (user_id - user_id % 3) + event_id % 20 END AS folder_id, user_name
        FROM feed WHERE event_type = 'click'"""),
    "claim": (
        "claim_event",
        """
        SELECT folder_id, user_name, CASE WHEN folder_id % 5 = 0 THEN CAST(floor(ts_ms / 1000) AS BIGINT) ELSE ts_ms END AS claimed_at
        FROM (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY ts_ms DESC, seq DESC) AS n FROM claim_event) c WHERE n = 1 AND folder_id % 6 <> 0""",
    ),
    "file_claim": (
        "file claim",
        """
        SELECT folder_id, user_name, claimed_at FROM
          (SELECT f.folder_id, c.user_name, c.claimed_at, row_number() OVER (PARTITION BY f.folder_id ORDER BY c.folder_id) AS n
           FROM (SELECT DISTINCT folder_id FROM file) f JOIN claim c ON f.folder_id % 25 + 100 = c.folder_id) x WHERE n = 1 AND folder_id % 3 = 0""",
    ),
    "decision_event": (
        "feed",
        """
        SELECT ts_ms, event_id AS seq, 10 * user_id + event_id % 10 + 1 AS file_id, CAST(CAST(floor(event_id / 7) AS BIGINT) % 3 AS INT) AS decision, user_name
        FROM feed WHERE event_type IN ('purchase', 'view')""",
    ),
    "known_user": ("feed", "SELECT user_name AS name, max(ts_ms) AS last_used FROM feed WHERE event_type = 'view' GROUP BY user_name"),
    "attempt": ("feed", "SELECT ts_ms, event_id AS seq, user_name AS source, event_type = 'signup' AS ok FROM feed WHERE event_type IN ('signup', 'error')"),
    "probe": (
        "part",
        """
        SELECT p_partkey + 1 AS file_id, CASE p_partkey % 7 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'vp9' WHEN 3 THEN 'av1' WHEN 4 THEN 'mjpeg' WHEN 5 THEN 'vp8' ELSE 'avc1' END AS codec,
               CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'aac' WHEN 2 THEN 'mp3' WHEN 3 THEN 'opus' ELSE 'pcm_s16le' END AS acodec,
               CAST(p_size * 97 % 4000 AS BIGINT) AS w, CAST(p_size * 61 % 3000 AS BIGINT) AS h, CAST(p_partkey % 9 AS INT) AS orientation,
               p_partkey % 11 <> 0 AS ok, p_partkey % 6 = 0 AS has_artifact,
               CASE p_partkey % 8 WHEN 1 THEN 'failed' WHEN 2 THEN 'transcoding' WHEN 3 THEN 'queued' END AS job
        FROM part""",
    ),
    "frame_hit": (
        "lineitem",
        """
        SELECT l_orderkey + 1 AS file_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS frame_idx,
               l_quantity < 15 AS blank, l_discount > 0.06 AS dirt, l_tax < 0.02 AS under, l_tax > 0.06 AS over, l_quantity > 20 AS blur, l_discount < 0.03 AS noise,
               l_linenumber AS dirt_blocks, substr(md5(concat(l_partkey, '-', l_suppkey)), 1, 16) AS dup_hash,
               CAST(l_quantity AS INT) % 17 - 8 AS dy, l_linenumber * 2 - 8 AS dx, l_extendedprice % 40 AS dist
        FROM lineitem""",
    ),
    "metric": (
        "lineitem",
        """
        SELECT l_orderkey + 1 AS file_id, l_quantity AS gray_std, l_extendedprice / 1000 AS exp_mean, l_discount * 8 AS clip_low, l_tax * 12 AS clip_high,
               l_quantity * 1.5 AS lap_std, l_discount * 100 AS noise_floor, l_linenumber % 5 = 0 AS dirty, l_linenumber * 100 + l_quantity AS tie, l_returnflag = 'R' AS corrupted
        FROM lineitem""",
    ),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


def _order(names: list[str]) -> list[str]:
    """The views that names need, each after what it reads."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in done:
            for other in VIEWS[name][0].split():
                visit(other)
            done.append(name)

    for name in names:
        visit(name)
    return done


def text(name: str, dialect: str) -> str:
    fill = DIALECTS[dialect]
    stamp = fill["stamp"].format("1704067200 + b.i * 4 - (b.i % 3) * 3")
    return VIEWS[name][1].replace("{ms}", fill["ms"]).replace("{stamp}", stamp)


def oracle(views: str, query: str) -> str:
    """DuckDB SQL: the query with the views it names in front."""
    names = _order(views.split())
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text(n, 'duckdb')})" for n in names) + ("," if query.lstrip().startswith(",") else "") + query.lstrip().removeprefix(",")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS, or a table, as a DataFrame."""
    names = _order([name])
    read = {t for n in names for t in VIEWS[n][0].split() if t not in VIEWS} or {name}
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in read}
    if name in frames:
        return frames[name]
    body = ",\n".join(f"{n} AS ({text(n, 'spark')})" for n in names)
    query = f"WITH {body} SELECT * FROM {name}".replace("{", "{{").replace("}", "}}")
    for t in frames:
        query = query.replace(f" {t} ", f" {{{t}}} ").replace(f" {t}\n", f" {{{t}}}\n").replace(f" {t})", f" {{{t}}})")
    return spark.sql(query, **frames)
