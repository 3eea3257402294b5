"""Queries of counts, trees, duplicates, the tag hierarchy and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import duplicates as D
from ..operators import gallery, hierarchy, suggest, tour
from ..sources.catalog import with_views
from .define import Book
from .gallery import CLOSURE, HID

book = Book()
FOLDER = r"regexp_replace(path, '[^\\]*$', '')"
ROOT = r"CASE WHEN regexp_matches(path, '^[A-Za-z]:\\') THEN substr(path, 1, 3) ELSE regexp_extract(path, '^\\\\[^\\]+\\[^\\]+\\', 0) END"

book.add("count_photos", lambda c: c.photos.agg(F.count(F.lit(1)).alias("photos")).join(c.tags.agg(F.count(F.lit(1)).alias("tags"))), "SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM tags) AS tags")
book.add("timeline", lambda c: A.timeline(c.photos), "SELECT year, month, count(*) AS n FROM photos GROUP BY year, month")
book.add("timeline_with_years", lambda c: A.timeline_with_years(c.photos).select("year", "month", F.col("level").cast("long").alias("level"), "n"), "SELECT year, month, CAST(grouping(year, month) AS BIGINT) AS level, count(*) AS n FROM photos GROUP BY ROLLUP (year, month)")
book.add("folder_counts", lambda c: A.folder_counts(c.photos), f"SELECT {FOLDER} AS folder, count(*) AS n FROM photos GROUP BY 1")
book.add("root_counts", lambda c: A.root_counts(c.photos), f"SELECT {ROOT} AS root, count(*) AS n FROM photos GROUP BY 1")
book.add(
    "folder_tree",
    lambda c: A.folder_tree(c.photos),
    rf"""SELECT above AS folder, CAST(sum(CASE WHEN above = f THEN n ELSE 0 END) AS BIGINT) AS own, CAST(sum(n) AS BIGINT) AS total FROM (
      SELECT f, n, unnest(list_concat([root], [root || array_to_string(parts[1:k], chr(92)) || chr(92) FOR k IN range(1, len(parts) + 1)])) AS above FROM (
        SELECT {FOLDER} AS f, any_value({ROOT}) AS root, count(*) AS n, list_filter(string_split(substr({FOLDER}, length(any_value({ROOT})) + 1), chr(92)), lambda x: x <> '') AS parts FROM photos GROUP BY {FOLDER})) GROUP BY above""",
)
book.add(
    "stats",
    lambda c: A.stats(c.photos),
    """SELECT 'year' AS kind, year, NULL::INT AS month, NULL::VARCHAR AS media_type, count(*) AS n FROM photos GROUP BY year UNION ALL SELECT 'month', year, month, NULL, count(*) FROM photos GROUP BY year, month
     UNION ALL SELECT 'type', NULL, NULL, coalesce(media_type, 'image'), count(*) FROM photos GROUP BY 4 UNION ALL SELECT 'all', NULL, NULL, NULL, count(*) FROM photos""",
)
book.add("tag_counts", lambda c: A.tag_counts(c.photo_tags), "SELECT tag_id, count(*) AS n FROM photo_tags GROUP BY tag_id")
book.add("top_tags", lambda c: A.top_tags(c.photo_tags, c.tags), "SELECT name, count(*) AS n FROM photo_tags JOIN tags ON id = tag_id GROUP BY name ORDER BY n DESC, name LIMIT 10")
book.add("count_tagged", lambda c: A.count_tagged(c.photos.where("year = 1996"), c.photo_tags), "SELECT count(DISTINCT photo_id) AS n FROM photo_tags WHERE photo_id IN (SELECT id FROM photos WHERE year = 1996)")
book.add("common_tags", lambda c: A.common_tags(gallery.apply_filter(c.photos, c.tags, c.photo_tags, c.tag_rejections, gallery.PhotoFilter(all_tags=(3, 9, 4))), c.photo_tags), "WITH own AS (SELECT photo_id FROM photo_tags WHERE tag_id IN (3, 9, 4) GROUP BY 1 HAVING count(*) = 3) SELECT tag_id FROM photo_tags WHERE photo_id IN (SELECT photo_id FROM own) GROUP BY tag_id HAVING count(*) = (SELECT count(*) FROM own)")
book.add("folder_tag_stats", lambda c: A.folder_tag_stats(c.photos, c.photo_tags).select("folder", "tag_id", "n", "total"), f"WITH f AS (SELECT id, {FOLDER} AS folder FROM photos), t AS (SELECT folder, count(*) AS total FROM f GROUP BY 1) SELECT folder, tag_id, count(*) AS n, any_value(total) AS total FROM f JOIN photo_tags ON photo_id = id JOIN t USING (folder) GROUP BY folder, tag_id")
book.add("trash_batches", lambda c: A.trash_batches(c.trash), "SELECT batch_id, reason, min(deleted_at) AS deleted_at, count(*) AS n, count(*) FILTER (WHERE tagged) AS tagged FROM trash GROUP BY batch_id, reason")
book.add(
    "review_progress",
    lambda c: A.review_stats(c.photos, c.photo_tags.join(hierarchy.expand(c.tags, [5]).select(F.col("tag").alias("tag_id")), "tag_id", "left_semi").select("photo_id"), c.tag_rejections.where("tag_id = 5").select("photo_id")),
    CLOSURE + """, t AS (SELECT DISTINCT photo_id FROM photo_tags JOIN clo ON clo.t = tag_id WHERE a = 5), r AS (SELECT photo_id FROM tag_rejections WHERE tag_id = 5), x AS (
      SELECT count(*) AS total, count(*) FILTER (WHERE id IN (SELECT photo_id FROM t)) AS tagged, count(*) FILTER (WHERE id IN (SELECT photo_id FROM r) AND id NOT IN (SELECT photo_id FROM t)) AS rejected FROM photos)
     SELECT total, tagged, rejected, greatest(0, total - tagged - rejected) AS pending FROM x""",
)
book.add("favourite_toggle", lambda c: A.favourite_toggle(c.photos.where("rating = 5")), "SELECT count(*) AS n, count(*) FILTER (WHERE favorite) AS favourites, count(*) FILTER (WHERE favorite) < count(*) AS set_to FROM photos WHERE rating = 5")
_ROOTS = "SELECT DISTINCT root FROM (SELECT {r} AS root FROM photos) WHERE root <> 'D:' || chr(92)".format(r=ROOT)
_up = lambda c: c.photos.select(S.root_of(F.col("path")).alias("root")).distinct().where(F.col("root") != "D:\\")
_BYROOT = f"""p AS (SELECT id, path, {ROOT} AS root, path IN (SELECT path FROM scan) AS here FROM photos), up AS ({_ROOTS}), v AS (SELECT root, count(*) AS total, count(*) FILTER (WHERE NOT here) AS missing,
   CASE WHEN root NOT IN (SELECT root FROM up) THEN 'unavailable' WHEN count(*) FILTER (WHERE NOT here) = count(*) AND count(*) >= 20 THEN 'all missing' ELSE 'report' END AS verdict FROM p GROUP BY root)"""
book.add("missing_by_root", lambda c: A.missing_by_root(c.photos, c.scan, _up(c)), f"WITH {_BYROOT} SELECT root, total, missing, verdict FROM v")
book.add("missing_files", lambda c: A.missing_ids(c.photos, c.scan, _up(c)), f"WITH {_BYROOT} SELECT id FROM p WHERE NOT here AND root IN (SELECT root FROM v WHERE verdict = 'report')")
book.add("aliases_by_tag", lambda c: c.tag_aliases.groupBy("tag_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases")), "SELECT tag_id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM tag_aliases GROUP BY tag_id")
book.add("tags_by_category", lambda c: A.tags_by_category(c.tags), "SELECT category, string_agg(name, ',' ORDER BY name) AS names FROM tags GROUP BY category")
book.add("tag_flags", lambda c: A.tag_flags(c.tags), "SELECT count(*) FILTER (WHERE hidden) AS hidden, count(*) FILTER (WHERE sidebar_hidden) AS sidebar_hidden, count(*) FILTER (WHERE hidden OR sidebar_hidden) AS either FROM tags")
book.add("assignments_by_path", lambda c: c.photo_tags.join(c.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").join(c.photos.select(F.col("id").alias("photo_id"), "path"), "photo_id").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")), "SELECT path, string_agg(tags.name, ',' ORDER BY tags.name) AS names FROM photo_tags JOIN tags ON tags.id = tag_id JOIN photos ON photos.id = photo_id GROUP BY path")
book.add("rejections_by_name", lambda c: c.tag_rejections.join(c.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("name", "photo_id"), "SELECT name, photo_id FROM tag_rejections JOIN tags ON id = tag_id")

# Exact and near duplicates.
_SHOWN = lambda c: gallery.with_hidden(c.photos, c.tags, c.photo_tags)
book.add("needs_hash", lambda c: D.needs_hash(c.photos).select("id", "path"), "SELECT id, path FROM photos WHERE md5 IS NULL AND filesize > 0 AND filesize IN (SELECT filesize FROM photos GROUP BY 1 HAVING count(*) > 1)")
book.add("duplicate_groups", lambda c: D.exact_groups(_SHOWN(c)), f"SELECT md5, count(*) AS n, CAST(sum(filesize) AS BIGINT) AS size, CAST(sum(filesize) - max(filesize) AS BIGINT) AS wasted, arg_max(id, (coalesce(width * height, 0), filesize, -id)) AS best, min(path) AS first_path FROM photos WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1 AND NOT bool_or(id IN {HID})")
book.add("reclaimable_bytes", lambda c: D.reclaimable(_SHOWN(c)), "SELECT CAST(sum(w) AS BIGINT) AS bytes FROM (SELECT sum(filesize) - max(filesize) AS w FROM photos WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1)")
book.add("keep_best_duplicate", lambda c: D.keep_best(c.photos).select("md5", "id", F.col("place").cast("long").alias("place")), "SELECT md5, id, row_number() OVER (PARTITION BY md5 ORDER BY coalesce(width * height, 0) DESC, filesize DESC NULLS LAST, id) AS place FROM photos WHERE md5 IN (SELECT md5 FROM photos WHERE md5 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
_SIMHASH = "WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS w FROM documents), x AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) AS x FROM w),"
_H = "h AS (SELECT doc_id AS id, " + " + ".join(f"CASE WHEN sum(((x >> {k}) & 1) * 2 - 1) > 0 THEN CAST({1 << k} AS BIGINT) ELSE 0 END" for k in range(60)) + " AS h FROM x GROUP BY doc_id)"
book.add("text_fingerprints", lambda c: D.text_fingerprint(c.base("documents")), f"{_SIMHASH} {_H} SELECT id, h FROM h")
book.add("near_pairs", lambda c: D.near_pairs(D.text_fingerprint(c.base("documents")), 6).select("a", "b", F.col("distance").cast("long").alias("distance")), f"{_SIMHASH} {_H}, one AS (SELECT h, min(id) AS id FROM h WHERE h <> 0 GROUP BY h) SELECT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, CAST(bit_count(xor(p.h, q.h)) AS BIGINT) AS distance FROM one p JOIN one q ON p.h < q.h AND bit_count(xor(p.h, q.h)) <= 6 UNION ALL SELECT one.id, h.id, CAST(0 AS BIGINT) FROM h JOIN one ON h.h = one.h AND h.id > one.id")
book.add(
    "near_pairs_and_members",
    lambda c: D.near_pairs_and_members(D.text_fingerprint(c.base("documents")), 6).select("a", "b", F.col("distance").cast("long").alias("distance")),
    f"""{_SIMHASH} {_H}, one AS (SELECT h, min(id) AS id FROM h WHERE h <> 0 GROUP BY h) SELECT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, CAST(bit_count(xor(p.h, q.h)) AS BIGINT) AS distance FROM one p JOIN one q ON p.h < q.h AND bit_count(xor(p.h, q.h)) <= 6
     UNION ALL SELECT h.id, one.id, CAST(0 AS BIGINT) FROM h JOIN one ON h.h = one.h""",
)
book.add("hamming_distances", lambda c: c.base("events").select("event_id", S.hamming(F.col("event_id"), F.col("user_id")).cast("long").alias("d")), "SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS BIGINT) AS d FROM events")
book.add("leader_groups", lambda c: D.leader_groups(D.text_fingerprint(c.base("documents")), 6))
book.add(
    "similar_groups",
    lambda c: D.similar_groups(_SHOWN(c), D.leader_groups(D.text_fingerprint(c.base("documents")), 6)),
)
book.add("perceptual_bits", lambda c: c.photo_embeddings.select("photo_id", S.perceptual_bits(F.col("vec")).alias("bits")), "SELECT photo_id, CASE WHEN b = 0 THEN 1 ELSE b END AS bits FROM (SELECT photo_id, list_reduce(list_transform(vec, lambda x: CAST(CASE WHEN x > list_sort(vec[2:64])[32] THEN 1 ELSE 0 END AS BIGINT)), lambda a, y: (a & 4611686018427387903) * 2 + y + CASE WHEN (a >> 62) & 1 = 1 THEN -9223372036854775808 ELSE 0 END) AS b FROM photo_embeddings)")

_LED = f"""WITH RECURSIVE {_SIMHASH[5:]} {_H}, o AS MATERIALIZED (SELECT id, h, row_number() OVER (ORDER BY id) AS k FROM h WHERE h <> 0),
  g(k, id, leader, centres) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(id BIGINT, h BIGINT)[])
    UNION ALL SELECT k, id, coalesce(near, id), CASE WHEN near IS NULL THEN list_append(centres, {{'id': id, 'h': h}}) ELSE centres END
    FROM (SELECT o.k, o.id, o.h, g.centres, list_filter(g.centres, lambda c: bit_count(xor(c.h, o.h)) <= 6)[1].id AS near FROM g JOIN o ON o.k = g.k + 1)),
  led AS (SELECT id, leader FROM (SELECT id, leader, count(*) OVER (PARTITION BY leader) AS n FROM g WHERE k > 0) WHERE n > 1)"""
book.oracles["leader_groups"] = with_views(f"{_LED} SELECT id, leader FROM led")
book.oracles["similar_groups"] = with_views(f"""{_LED}, y AS (SELECT leader, count(*) AS n, CAST(sum(filesize) AS BIGINT) AS size, min(path) AS first_path, bool_or(p.id IN {HID}) AS hid, count(DISTINCT md5) AS m, count(*) FILTER (WHERE md5 IS NULL) AS nulls FROM led JOIN photos p ON p.id = led.id GROUP BY leader)
  SELECT leader, n, size, first_path FROM y WHERE n > 1 AND NOT hid AND NOT (m = 1 AND nulls = 0)""")

# The tag hierarchy.
_C = "WITH RECURSIVE clo(a, t, d) AS (SELECT parent_id, id, 1 FROM tags WHERE parent_id IS NOT NULL UNION SELECT clo.a, tags.id, clo.d + 1 FROM clo JOIN tags ON tags.parent_id = clo.t)"
_PATH = "WITH RECURSIVE p(id, depth, path, names) AS (SELECT id, 0, name, [name] FROM tags WHERE parent_id IS NULL UNION ALL SELECT t.id, depth + 1, path || ' › ' || t.name, list_append(names, t.name) FROM p JOIN tags t ON t.parent_id = p.id)"
book.add("tag_parents", lambda c: hierarchy.parents(c.tags), "SELECT id, parent_id FROM tags WHERE parent_id IS NOT NULL")
book.add("tag_descendants", lambda c: hierarchy.descendants(c.tags), f"{_C} SELECT a AS ancestor, t AS tag, d AS depth FROM clo")
book.add("tag_paths", lambda c: hierarchy.tag_paths(c.tags).select("id", "depth", "path"), f"{_PATH} SELECT id, depth, path FROM p")
_WALK = """WITH RECURSIVE p(id, depth, way) AS (SELECT id, 0, [(lower(name), id)] FROM tags WHERE parent_id IS NULL UNION ALL SELECT t.id, depth + 1, list_append(way, (lower(t.name), t.id)) FROM p JOIN tags t ON t.parent_id = p.id),
  o AS (SELECT id, depth, way, row_number() OVER (ORDER BY way) - 1 AS k FROM p), s AS (SELECT a.id, count(*) AS size FROM o a JOIN o b ON b.way[1:len(a.way)] = a.way GROUP BY a.id)"""
book.add("tag_tour", lambda c: tour.euler_tour(c.tags).drop("cycle"), f"{_WALK} SELECT id, 2 * k - depth AS entry, 2 * k - depth + 2 * size - 1 AS exit, CAST(depth AS BIGINT) AS depth FROM o JOIN s USING (id)")
book.add("tag_ranges", lambda c: tour.below(tour.euler_tour(c.tags), c.tags), f"{_C} SELECT CAST(a AS BIGINT) AS ancestor, CAST(t AS BIGINT) AS tag FROM clo UNION SELECT id, id FROM tags")
book.add("tag_tree_order", lambda c: hierarchy.tree_order(c.tags), f"{_PATH} SELECT id, depth, path FROM p")
book.add("tag_search_text", lambda c: hierarchy.search_text(c.tags, c.tag_aliases), f"{_PATH}, al AS (SELECT tag_id, string_agg(alias, ' ' ORDER BY alias) AS al FROM tag_aliases GROUP BY 1) SELECT id, lower(concat_ws(' ', array_to_string(names, ' '), al)) AS text FROM p LEFT JOIN al ON tag_id = id")
book.add("reparent_check", lambda c: hierarchy.reparent_check(c.tags, c.tags.select(F.col("id").alias("tag"), "category").join(c.tags.select(F.col("id").alias("parent"), "category"), "category").drop("category")), f"{_C} SELECT x.id AS tag, y.id AS parent, x.id <> y.id AND NOT EXISTS (SELECT 1 FROM clo WHERE a = x.id AND t = y.id) AS allowed FROM tags x JOIN tags y ON y.category = x.category")
book.add("resolve_names", lambda c: hierarchy.resolve_names(c.tag_aliases.select(F.upper("alias").alias("name")).unionByName(c.tags.select(F.concat(F.lit(" "), "name").alias("name"))), c.tags, c.tag_aliases), "SELECT upper(alias) AS name, tag_id FROM tag_aliases UNION ALL SELECT ' ' || name, id FROM tags")
book.add("name_conflicts", lambda c: hierarchy.name_conflicts(c.tags, c.tag_aliases.unionByName(c.tags.where("parent_id IS NULL").select(F.upper("name").alias("alias"), F.lit(9).alias("tag_id")))), "SELECT name, CAST(2 AS BIGINT) AS n FROM tags WHERE parent_id IS NULL")
book.add("merge_tags_photos", lambda c: hierarchy.merge_tags(c.tags, c.photo_tags, c.tag_aliases, 3, 9)[1], "SELECT DISTINCT photo_id, CASE WHEN tag_id = 3 THEN 9 ELSE tag_id END AS tag_id FROM photo_tags")
book.add("merge_tags_tree", lambda c: hierarchy.merge_tags(c.tags, c.photo_tags, c.tag_aliases, 3, 9)[0].select("id", "parent_id"), "SELECT id, CASE WHEN id = 9 THEN NULL WHEN parent_id = 3 THEN 9 ELSE parent_id END AS parent_id FROM tags WHERE id <> 3")
book.add("merge_tags_aliases", lambda c: hierarchy.merge_tags(c.tags, c.photo_tags, c.tag_aliases, 4, 9)[2], "SELECT alias, CASE WHEN tag_id = 4 THEN 9 ELSE tag_id END AS tag_id FROM tag_aliases UNION SELECT name, 9 FROM tags WHERE id = 4")
book.add("delete_tag_tree", lambda c: hierarchy.delete_tag(c.tags, c.photo_tags, 3)[0].select("id", "parent_id"), "SELECT id, CASE WHEN parent_id <> 3 THEN parent_id END AS parent_id FROM tags WHERE id <> 3")
book.add("delete_tag_photos", lambda c: hierarchy.delete_tag(c.tags, c.photo_tags, 3)[1], "SELECT photo_id, tag_id FROM photo_tags WHERE tag_id <> 3")
book.add("rename_category", lambda c: hierarchy.rename_category(c.tags, c.categories, "cat2", " Viajes ")[0].select("id", "category"), "SELECT id, CASE WHEN category = 'cat2' THEN 'viajes' ELSE category END AS category FROM tags")

book.add("categories_after_rename", lambda c: hierarchy.rename_category(c.tags, c.categories, "cat2", "CAT4")[1], "SELECT name FROM categories WHERE name <> 'cat2'")
book.add("delete_category", lambda c: (lambda t, k: t.select("name", "category").unionByName(k.select("name", F.lit("").alias("category"))))(*hierarchy.delete_category(c.tags, c.categories, "cat1")), "SELECT name, CASE WHEN category = 'cat1' THEN 'general' ELSE category END AS category FROM tags UNION ALL SELECT name, '' FROM categories WHERE name <> 'cat1' UNION ALL SELECT 'general', ''")

# Suggestions.
_SUGGEST = rf"""WITH f AS (SELECT id, {FOLDER} AS folder FROM photos), tot AS (SELECT folder, count(*) AS total FROM f GROUP BY 1),
  st AS (SELECT folder, tag_id, count(*) / any_value(total) AS share, count(*) AS n, any_value(total) AS total FROM f JOIN photo_tags ON photo_id = id JOIN tot USING (folder) GROUP BY folder, tag_id HAVING count(*) >= 2 AND count(*) / any_value(total) >= 0.2),
  up AS (SELECT folder, regexp_replace(regexp_replace(folder, '\\+$', ''), '[^\\]*$', '') AS above FROM tot),
  w AS (SELECT id AS tag_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS w, name AS word, 0 AS kind FROM tags UNION ALL SELECT tag_id, lower(alias), alias, 1 FROM tag_aliases),
  parts AS (SELECT folder, unnest(list_filter(string_split(regexp_replace(folder, '\\+$', ''), chr(92))[2:], lambda x: x <> '')[-2:]) AS part FROM tot),
  offers AS (SELECT folder, tag_id, share AS s, 'La tienen ' || n || ' de ' || total || ' fotos de esta carpeta' AS why, 0 AS turn FROM st UNION ALL SELECT up.folder, tag_id, share * 0.5, 'La tienen ' || n || ' de ' || total || ' fotos de la carpeta de arriba', 1 FROM up JOIN st ON st.folder = up.above
    UNION ALL SELECT folder, tag_id, 0.9, '«' || arg_min(word, (kind, word)) || '» aparece en el nombre de la carpeta', 2 FROM parts JOIN w ON contains(' ' || trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || w || ' ') GROUP BY folder, tag_id),
  best AS (SELECT folder, tag_id, name, max(s) AS s, arg_max(why, (s, -turn)) AS reason FROM offers JOIN tags ON tags.id = tag_id WHERE NOT hidden GROUP BY ALL)"""
book.add("folder_suggestions", lambda c: suggest.folder_suggestions(c.photos, c.photo_tags, c.tags, c.tag_aliases), f"{_SUGGEST} SELECT photo_id, tag_id, round(s, 3) AS score, reason FROM (SELECT f.id AS photo_id, tag_id, s, reason, row_number() OVER (PARTITION BY f.id ORDER BY s DESC, name) AS k FROM f JOIN best USING (folder) WHERE NOT EXISTS (SELECT 1 FROM photo_tags p WHERE p.photo_id = f.id AND p.tag_id = best.tag_id)) WHERE k <= 6")
book.add("selection_suggestions", lambda c: suggest.selection_suggestions(c.photos.where("year = 1996 AND month = 5"), c.photos, c.photo_tags, c.tags, c.tag_aliases), f"{_SUGGEST}, own AS (SELECT id, folder FROM f WHERE id IN (SELECT id FROM photos WHERE year = 1996 AND month = 5)) SELECT tag_id, name, round(max(s), 3) AS score, arg_max(reason, (s, folder)) AS reason FROM best WHERE folder IN (SELECT folder FROM own) AND tag_id NOT IN (SELECT tag_id FROM photo_tags WHERE photo_id IN (SELECT id FROM own) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM own)) GROUP BY tag_id, name ORDER BY score DESC, name LIMIT 6")
book.add("repeat_previous", lambda c: suggest.repeat_previous(c.photos, c.photo_tags), f"WITH own AS (SELECT photo_id, list_sort(list(tag_id)) AS own FROM photo_tags GROUP BY 1), p AS (SELECT id, coalesce(own, []) AS own, lag(coalesce(own, [])) OVER (PARTITION BY {FOLDER} ORDER BY filename, id) AS before FROM photos LEFT JOIN own ON photo_id = id) SELECT id, array_to_string(list_filter(before, lambda x: NOT list_contains(own, x)), ',') AS add FROM p WHERE before IS NOT NULL")
