"""Counters, orders, keys, trees of snapshots and whole exchanges as queries, next to the SQL that means the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import Domain
from ..functions import keys, paths
from ..operators import changes, content, diff, exchange, listing, state, summary, sync, tree, walk
from ..scratch import materialize
from .queries import DIFF, DOC_FILES, GROUPED, LEFT, MISSING, REPO, RIGHT, SOURCE, STATES, STATUS, TARGET, WALKED, _cached, _doc_files, _hex, _texts, level_sql, query

FAST = STATUS.format(differs="w.size <> c.size OR w.mtime <> c.mtime")
N = "count(*) FILTER (WHERE {c} = '{v}') AS {n}"


def counted_sql(rows: str, column: str, names: dict[str, str]) -> str:
    return "SELECT " + ", ".join(N.format(c=column, v=v, n=n) for v, n in names.items()) + f" FROM ({rows}) counted"


# ---- counters

@query(counted_sql(FAST, "state", {k: k for k in ("added", "modified", "deleted", "unmodified")}), *WALKED)
def status_counts(d: Domain) -> DataFrame:
    return summary.status_counts(changes.status_fast(_cached(d, 15), _cached(d, 12)))


@query("""SELECT count(*) FILTER (WHERE w.digest = c.digest) AS ok, count(*) FILTER (WHERE w.digest <> c.digest) AS modified, count(*) FILTER (WHERE w.path IS NULL) AS missing, count(*) FILTER (WHERE false) AS errors
FROM c LEFT JOIN w ON w.repository_id = c.repository_id AND w.path = c.path""", *WALKED)
def verify_counts(d: Domain) -> DataFrame:
    return summary.verify_counts(changes.verify(_cached(d, 12), _cached(d, 15)))


@query(f"""SELECT count(*) FILTER (WHERE push AND local) AS pushed, count(*) FILTER (WHERE NOT push) AS skipped, count(*) FILTER (WHERE push AND NOT local) AS errors FROM (
  SELECT path = min(path) OVER (PARTITION BY object_id) AND object_id NOT IN (SELECT object_id FROM f_replicas WHERE store_id = {TARGET}) AS push, NOT starts_with(path, 'd0/') AS local
  FROM f_entry_cache WHERE repository_id = {REPO} AND status = 1) x""")
def store_push_counts(d: Domain) -> DataFrame:
    """Files of d0/ are gone from the disk."""
    return summary.push_counts(content.push_plan(d.cache, d.replicas, REPO, TARGET), listing.files(d.cache, REPO).where(~F.col("path").startswith("d0/")))


@query(f"""SELECT count(m.object_id) AS copied, count(*) - count(m.object_id) AS skipped, cast(coalesce(sum(o.size) FILTER (WHERE m.object_id IS NOT NULL), 0) AS bigint) AS bytes
FROM (SELECT DISTINCT object_id FROM f_replicas WHERE store_id = {SOURCE}) r JOIN f_objects o ON r.object_id = o.object_id LEFT JOIN ({MISSING}) m ON r.object_id = m.object_id""")
def store_copy_counts(d: Domain) -> DataFrame:
    return summary.copy_counts(content.copy_plan(d.replicas, d.objects, SOURCE, TARGET), d.replicas.where(F.col("store_id") == SOURCE))


@query("""SELECT count(*) FILTER (WHERE NOT encrypted AND object_id % 7 <> 0 AND object_id % 11 <> 0) AS ok, count(*) FILTER (WHERE NOT encrypted AND object_id % 7 <> 0 AND object_id % 11 = 0) AS corrupt,
  count(*) FILTER (WHERE NOT encrypted AND object_id % 7 = 0) AS missing, count(*) FILTER (WHERE encrypted) AS skipped FROM f_replicas""")
def store_verify_counts(d: Domain) -> DataFrame:
    blobs = d.replicas.where("object_id % 7 <> 0").join(d.objects, "object_id")
    size = F.col("size") - (F.col("object_id") % 11 == 0).cast("int")
    blobs = blobs.select("store_id", "path", F.col("digest").alias("blob_digest"), size.alias("blob_size"))
    return summary.store_verify_counts(content.store_verify(d.replicas, d.objects, blobs))


@query("""SELECT count(*) FILTER (WHERE NOT there AND usable) AS restored, count(*) FILTER (WHERE there) AS skipped, count(*) FILTER (WHERE NOT there AND NOT usable) AS errors FROM (
  SELECT EXISTS (SELECT 1 FROM a WHERE a.path = b.path AND a.object_id = b.object_id) AS there, b.object_id IN (SELECT object_id FROM f_replicas WHERE NOT encrypted) AS usable FROM b) x""", *STATES)
def restore_counts(d: Domain) -> DataFrame:
    """The files of the earlier snapshot are on the disk."""
    plan = content.restore_plan(state.as_of_in(d.entries, REPO, RIGHT), d.replicas, d.stores)
    return summary.restore_counts(plan, state.as_of_in(d.entries, REPO, LEFT))


@query("SELECT snapshot_id, count(*) FILTER (WHERE status = 1) AS present, count(*) FILTER (WHERE status = 0) AS deleted FROM f_entries GROUP BY snapshot_id")
def snapshot_present_deleted(d: Domain) -> DataFrame:
    return summary.snapshot_counts(d.entries)


def _grouped(d: Domain) -> DataFrame:
    return diff.by_object(d.entries, LEFT, RIGHT, repository_id=REPO)


@query("SELECT count(*) FILTER (WHERE left_paths = '') AS added, count(*) FILTER (WHERE right_paths = '') AS deleted, count(*) FILTER (WHERE left_paths <> '' AND right_paths <> '') AS kept FROM g", *STATES, GROUPED)
def diff_side_counts(d: Domain) -> DataFrame:
    return summary.side_counts(_grouped(d))


# ---- orders

@query(f"SELECT * FROM ({DIFF}) x ORDER BY path LIMIT 7", *STATES)
def diff_first_rows(d: Domain) -> DataFrame:
    return summary.first_rows(diff.snapshot_diff(d.entries, d.objects, LEFT, RIGHT, repository_id=REPO), ["path"], 7)


@query("""SELECT object_id, left_paths, right_paths FROM g ORDER BY CASE WHEN right_paths = '' THEN 0 WHEN left_paths = '' THEN 1 ELSE 2 END,
  CASE WHEN left_paths = '' THEN split_part(right_paths, ',', 1) ELSE split_part(left_paths, ',', 1) END, object_id LIMIT 25""", *STATES, GROUPED)
def diff_page_order(d: Domain) -> DataFrame:
    return _texts(summary.first_rows(_grouped(d), summary.side_order(), 25))


@query("SELECT object_id, key, value FROM f_tags ORDER BY key, object_id LIMIT 30")
def tags_list(d: Domain) -> DataFrame:
    return summary.first_rows(d.tags.select("object_id", "key", "value"), ["key", "object_id"], 30)


@query("""SELECT concat('repo', e.repository_id) AS repository, e.snapshot_id, s.created_at, e.path, e.status FROM f_entries e JOIN f_snapshots s ON e.snapshot_id = s.snapshot_id WHERE e.object_id = 13""")
def object_page(d: Domain) -> DataFrame:
    repositories = d.snapshots.select("repository_id").distinct().withColumn("name", F.concat(F.lit("repo"), F.col("repository_id").cast("string")))
    return summary.object_page(listing.object_references(d.entries, d.snapshots, 13), repositories)


# ---- tags, settings, keys, paths

@query("SELECT object_id, key, value FROM f_tags WHERE NOT (key = 'toxic' AND object_id % 3 = 0)")
def tags_delete(d: Domain) -> DataFrame:
    return content.tags_delete(d.tags, d.objects.where("object_id % 3 = 0").select("object_id", F.lit("toxic").alias("key"))).select("object_id", "key", "value")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS kept, concat('n', event_id) AS added, 'none' AS removed FROM events""")
def json_config_set(d: Domain) -> DataFrame:
    """A key is added beside ``k``; then ``k`` is removed."""
    added = content.json_set(F.col("props"), "more", F.concat(F.lit("n"), F.col("event_id").cast("string")))
    rows = d.table("events").select("event_id", added.alias("props"))
    gone = content.json_set(F.col("props"), "k", F.lit(None).cast("string"))
    return rows.select("event_id", content.json_get(F.col("props"), "k", "none").alias("kept"), content.json_get(gone, "more", "none").alias("added"), content.json_get(gone, "k", "none").alias("removed"))


@query("SELECT object_id, CASE object_id % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 2 THEN 'executable' ELSE 'regular' END AS kind FROM f_objects")
def file_kinds(d: Domain) -> DataFrame:
    modes = F.array(*(F.lit(m) for m in (0o040755, 0o120777, 0o100755, 0o100644)))
    return d.objects.select("object_id", paths.file_kind(F.element_at(modes, (F.col("object_id") % 4 + 1).cast("int"))).alias("kind"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_http FROM pages WHERE url LIKE '%://%'")
def url_schemes(d: Domain) -> DataFrame:
    return d.table("pages").where(F.col("url").contains("://")).select("page_id", keys.scheme(F.col("url")).alias("scheme"), keys.is_http(F.col("url")).alias("is_http"))


@query("""SELECT store_id, store_id % 2 = 0 AS encrypt, CASE WHEN store_id % 2 = 0 THEN concat('key', store_id) END AS key_file, CAST(NULL AS varchar) AS cipher FROM f_stores""")
def store_configs(d: Domain) -> DataFrame:
    """Odd stores have settings that can't be read."""
    even = F.to_json(F.struct(F.lit(True).alias("encrypt"), F.concat(F.lit("key"), F.col("store_id").cast("string")).alias("key_file")))
    rows = d.stores.select("store_id", keys.store_config(F.when(F.col("store_id") % 2 == 0, even).otherwise("{not json")).alias("c"))
    return rows.select("store_id", "c.encrypt", "c.key_file", "c.cipher")


@query("""SELECT e.snapshot_id, e.path, concat('SNAP#', lpad(cast(e.snapshot_id AS varchar), 19, '0')) AS pk, concat('ENTRY#', e.path) AS sk, concat('REPO#r', e.repository_id, '#SRC#', e.repository_id) AS source,
  concat('REPO#r', e.repository_id, '#PATH#', e.path) AS history FROM f_entries e""")
def composite_keys(d: Domain) -> DataFrame:
    repo = F.concat(F.lit("r"), F.col("repository_id").cast("string"))
    return d.entries.select("snapshot_id", "path", keys.numbered(keys.SNAP, F.col("snapshot_id")).alias("pk"), keys.named(keys.ENTRY, F.col("path")).alias("sk"), keys.of_source(repo, F.col("repository_id")).alias("source"), keys.of_path(repo, F.col("path")).alias("history"))


@query(f"SELECT concat('CACHE#', path) AS sk, object_id FROM f_entry_cache WHERE repository_id = {REPO} AND starts_with(path, 'd2/') AND path > 'd2/s1' ORDER BY path LIMIT 4")
def key_range_page(d: Domain) -> DataFrame:
    table = d.cache.select(keys.named(keys.REPO, F.col("repository_id")).alias("pk"), keys.named(keys.CACHE, F.col("path")).alias("sk"), "object_id")
    return keys.query(table, f"{keys.REPO}{REPO}", begins_with=f"{keys.CACHE}d2/", after=f"{keys.CACHE}d2/s1", limit=4).select("sk", "object_id")


@query(f"SELECT path, object_id FROM f_entry_cache WHERE repository_id = {REPO} AND status = 1 AND path LIKE 'd_/s2%'")
def files_wildcard_prefix(d: Domain) -> DataFrame:
    return listing.files(d.cache, REPO, "d_/s2", wildcards=True).select("path", "object_id")


CRUMBS = "p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)"


@query("""SELECT page_id, labels, CASE WHEN labels = '' THEN 0 ELSE length(labels) - length(replace(labels, '>', '')) + 1 END AS n, regexp_extract(path, '[^/]*$') AS shown
FROM (SELECT page_id, path, regexp_replace(trim(path, '/'), '/+', '>', 'g') AS labels FROM p) x""", CRUMBS)
def page_breadcrumbs(d: Domain) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    rows = d.table("pages").select("page_id", path.alias("path"))
    crumbs = keys.breadcrumbs(F.col("path"))
    directory = F.when(F.col("path").contains("/"), F.concat(paths.parent(F.col("path")), F.lit("/"))).otherwise("")
    return rows.select("page_id", F.array_join(F.transform(crumbs, lambda x: x["label"]), ">").alias("labels"), F.size(crumbs).cast("long").alias("n"), keys.display_name(F.col("path"), directory).alias("shown"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS text, date_trunc('second', ts) AS moment FROM events")
def rfc3339_round_trip(d: Domain) -> DataFrame:
    text = keys.rfc3339(F.col("ts"), zoned=False)
    back = F.to_utc_timestamp(keys.parse_rfc3339(text), F.current_timezone()).cast("timestamp_ntz")
    return d.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("event_id", text.alias("text"), back.alias("moment"))


# ---- differences, trees

@query("SELECT side, path FROM (SELECT 1 AS side, path FROM f_entry_cache WHERE repository_id = 0 AND status = 0 UNION ALL SELECT 2 AS side, path FROM f_entry_cache WHERE repository_id = 1 AND status = 0) x")
def cross_repo_deleted(d: Domain) -> DataFrame:
    return diff.cross_deleted(d.cache, 0, 1)


ENTRY_FILES = f"SELECT e.snapshot_id AS tree, e.path, o.digest AS h FROM f_entries e JOIN f_objects o ON e.object_id = o.object_id WHERE e.status = 1 AND e.repository_id = {REPO}"


def _trees(d: Domain) -> tuple[DataFrame, DataFrame]:
    mine = F.col("repository_id") == REPO
    objects = d.objects.withColumn("digest", F.unhex("digest"))
    return walk.snapshot_trees(d.entries.where(mine), objects, d.snapshots.where(mine), depth=2)


@query(f"SELECT s.snapshot_id, t.h AS root FROM f_snapshots s LEFT JOIN t3 t ON s.snapshot_id = t.tree WHERE s.repository_id = {REPO}", *level_sql(ENTRY_FILES))
def snapshot_tree_roots(d: Domain) -> DataFrame:
    return _trees(d)[1].withColumn("root", F.lower(F.hex("root")))


@query("SELECT tree AS snapshot_id, path, h AS digest FROM t1 UNION ALL SELECT tree, path, h FROM t2", *level_sql(ENTRY_FILES))
def snapshot_tree_directories(d: Domain) -> DataFrame:
    return _hex(_trees(d)[0])


@query("""SELECT path, concat(CASE WHEN kind = 'D' THEN '040000 tree ' ELSE '100644 blob ' END, h, chr(9), CASE WHEN path = '' THEN '.' ELSE path END) AS line
FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) n""", *level_sql(DOC_FILES))
def tree_walk_listing(d: Domain) -> DataFrame:
    return walk.listing(tree.nodes(_doc_files(d), depth=2), show_root=True)


@query(None)
def tree_root_fast(d: Domain) -> DataFrame:
    """A tree over 64-bit hashes; XXH64 has no SQL."""
    files = d.documents.select(F.lit(0).alias("tree"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.unhex(F.substring("digest", 1, 16)).alias("digest"))
    return _hex(tree.roots(files, depth=2, digest=tree.fast_digest).select("digest", "n_files", "n_dirs"))


# ---- exchange

@query("SELECT snapshot_id, path, status, object_id FROM f_entries WHERE status = 0 OR (object_id IS NOT NULL AND object_id % 5 <> 0)")
def sync_acceptable(d: Domain) -> DataFrame:
    """Sizes of every fifth object are unknown."""
    rows = d.entries.join(d.objects.select("object_id", "digest", F.when(F.col("object_id") % 5 != 0, F.col("size")).alias("size")), "object_id", "left")
    return sync.acceptable(rows).select("snapshot_id", "path", "status", "object_id")


def _sides(d: Domain) -> tuple[exchange.Tables, exchange.Tables]:
    """A peer that has repository 0 up to day 15, and all there is."""
    entries = materialize(d.entries.where(F.col("repository_id") == REPO).select("repository_id", "snapshot_id", "path", "status", "object_id", "mtime", "depth"), "entries")
    snapshots = d.snapshots.where(F.col("repository_id") == REPO).withColumn("source_machine_id", F.lit(7).cast("long")).withColumn("source_snapshot_id", F.col("snapshot_id"))
    snapshots = materialize(snapshots, "snapshots")
    early = "snapshot_id <= 15"
    whole = exchange.Tables(snapshots, entries, state.latest(entries), d.objects, d.stores, d.replicas)
    known = entries.where(early)
    objects = d.objects.join(known.select("object_id").distinct(), "object_id", "left_semi")
    return exchange.Tables(snapshots.where(early), known, state.latest(known), objects, d.stores.where("store_id = 0"), d.replicas.limit(0)), whole


PULLED = f"""SELECT c.path, c.status, o.digest FROM (SELECT * FROM f_entry_cache WHERE repository_id = {REPO}) c LEFT JOIN f_objects o ON c.object_id = o.object_id"""


@query(PULLED)
def sync_pull_whole(d: Domain) -> DataFrame:
    """The peer's cache after a pull, contents by digest: as the source's own."""
    peer, whole = _sides(d)
    after = exchange.pull_apply(peer, whole, REPO, 7, 15)
    return after.cache.join(after.objects.select("object_id", "digest"), "object_id", "left").select("path", "status", "digest")


@query(f"""SELECT source_snapshot_id, 15 + row_number() OVER (ORDER BY created_at, source_snapshot_id) AS snapshot_id, 14 + row_number() OVER (ORDER BY created_at, source_snapshot_id) AS parent_id
FROM (SELECT snapshot_id AS source_snapshot_id, created_at FROM f_snapshots WHERE repository_id = {REPO} AND snapshot_id > 15) x""")
def sync_pull_snapshots(d: Domain) -> DataFrame:
    """Days 10 to 15 are known and left out; what is new follows the newest here."""
    peer, whole = _sides(d)
    after = exchange.pull_apply(peer, whole, REPO, 7, 10)
    return after.snapshots.where("source_snapshot_id > 15").select("source_snapshot_id", "snapshot_id", "parent_id")


@query(f"SELECT 15 + row_number() OVER (ORDER BY created_at, snapshot_id) AS snapshot_id FROM f_snapshots WHERE repository_id = {REPO} AND snapshot_id > 10")
def sync_push_database(d: Domain) -> DataFrame:
    """Not idempotent: days 11 to 15 arrive again."""
    peer, whole = _sides(d)
    return exchange.push_to_database(whole, peer, REPO, 10, 16).snapshots.where("source_machine_id is null").select("snapshot_id")
