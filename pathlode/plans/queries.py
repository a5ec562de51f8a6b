"""Every registered query, next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.functions import dates, filetypes, marks, sizes, words
from pathlode.functions.paths import with_parts
from pathlode.operators import changes as ch
from pathlode.operators import grams, hierarchy, monitor, reconcile, sorting, totals
from pathlode.operators.excludes import Excludes, apply_excludes
from pathlode.operators.predicates import lookup, matches, name_starts_with
from pathlode.operators.terms import AnyOf, Glob, Not, Regex, Substring
from pathlode.plans.search import desktop_rows, search
from pathlode.plans.views_sql import with_views
from pathlode.plans.build import build_catalogue, refresh, refresh_from_inventory
from pathlode.schema import ENTRY_FIELDS, PART_FIELDS, STORED
from pathlode.session import is_folder, new_folder, written
from pathlode.sources import catalogue, inventory, tables
from pathlode.sources.export import export
from pathlode.streaming import fold

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ENTRY_SQL = "path, is_dir, size, modified, created, accessed"


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(spark, folder)

        QUERIES[name] = run
        ORACLE[name] = with_views(sql)
        return query

    return add


# --- Sources -----------------------------------------------------------------


@register("entries_docs", f"SELECT {ENTRY_SQL} FROM doc_entries")
def entries_docs(spark, folder):
    return inventory.as_entries(tables.doc_entries(spark, folder))


@register("entries_lines", f"SELECT {ENTRY_SQL} FROM line_entries")
def entries_lines(spark, folder):
    return inventory.as_entries(tables.line_entries(spark, folder))


def _damaged_lines(entries: DataFrame) -> str:
    """Entries as lines of JSON, some with a size that is no number and some cut short."""
    target = new_folder(entries.sparkSession, "damaged-lines")
    size = F.concat(F.when(F.col("size") % 7 == 0, "x").otherwise(""), F.col("size").cast("string"))
    line = F.to_json(F.struct(*[size.alias(c) if c == "size" else c for c in ENTRY_FIELDS]))
    cut = F.when(F.col("size") % 11 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    entries.withColumn("line", line).select(cut.alias("value")).write.text(target)
    return target


@register(
    "inventory_lost_lines",
    """SELECT path, CASE WHEN size % 11 = 0 THEN 'path' ELSE 'size' END AS faults
       FROM line_entries WHERE size % 7 = 0 OR size % 11 = 0""",
)
def inventory_lost_lines(spark, folder):
    """Lines that an inventory could not give as entries, and why."""
    lost = inventory.lost_lines(spark, _damaged_lines(tables.line_entries(spark, folder)), "json")
    path = F.regexp_extract("line", '"path":"([^"]*)"', 1)
    return lost.select(path.alias("path"), F.array_join("faults", ",").alias("faults"))


@register("refresh_lossy_inventory", "SELECT path, size FROM doc_entries")
def refresh_lossy_inventory(spark, folder):
    """Entries whose lines were lost stay in the catalogue."""
    target, entries = new_folder(spark, "lossy"), tables.doc_entries(spark, folder)
    refresh(spark, target, entries)
    refresh_from_inventory(spark, target, _damaged_lines(entries), "json")
    return catalogue.load_catalogue(spark, target).select("path", "size")


@register(
    "entries_no_metadata",
    "SELECT path, is_dir, 0::BIGINT AS size, 0::BIGINT AS modified, 0::BIGINT AS created, "
    "0::BIGINT AS accessed FROM doc_entries",
)
def entries_no_metadata(spark, folder):
    return inventory.without_metadata(tables.doc_entries(spark, folder))


@register(
    "multi_root",
    f"""SELECT {ENTRY_SQL} FROM doc_entries
        UNION ALL SELECT {ENTRY_SQL} FROM part_entries
        UNION ALL SELECT DISTINCT {ENTRY_SQL} FROM page_entries
        WHERE (path, size) IN (SELECT path, max(size) FROM page_entries GROUP BY path)""",
)
def multi_root(spark, folder):
    docs = tables.doc_entries(spark, folder)
    nested = hierarchy.under(docs, docs.filter("is_dir").select("path"))
    pages, parts = tables.page_entries(spark, folder), tables.part_entries(spark, folder)
    return inventory.union_roots(docs, nested, parts, pages)


@register(
    "derive_directories",
    """SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path
       FROM (SELECT path, unnest(range(2, len(string_split(path, '/')))) AS n
             FROM (SELECT path FROM page_entries UNION ALL SELECT path FROM line_entries))""",
)
def derive_directories(spark, folder):
    both = tables.page_entries(spark, folder).unionByName(tables.line_entries(spark, folder))
    return hierarchy.derive_directories(both)


@register(
    "with_directories",
    f"""SELECT {ENTRY_SQL} FROM order_entries
        UNION ALL
        SELECT DISTINCT parent, true, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
        FROM order_entries_p
        UNION ALL SELECT '/archive', true, 0, 0, 0, 0""",
)
def with_directories(spark, folder):
    return inventory.with_directories(tables.order_entries(spark, folder))


@register(
    "with_directories_docs",
    f"""SELECT {ENTRY_SQL} FROM doc_entries
        UNION ALL
        SELECT path, true, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
        FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path
              FROM (SELECT path, unnest(range(2, len(string_split(path, '/')))) AS n
                    FROM doc_entries))
        WHERE path NOT IN (SELECT path FROM doc_entries)""",
)
def with_directories_docs(spark, folder):
    """Directories that are listed already are not added again."""
    return inventory.with_directories(tables.doc_entries(spark, folder))


@register(
    "snapshot_roundtrip",
    f"SELECT {ENTRY_SQL}, name, parent, extension, name_lc FROM doc_entries_p",
)
def snapshot_roundtrip(spark, folder):
    target = new_folder(spark, "catalogue")
    catalogue.save_catalogue(tables.doc_entries(spark, folder), target)
    return catalogue.load_catalogue(spark, target).select(*STORED.fieldNames())


@register("changes_source", "SELECT seq, kind, path, is_dir, size, modified FROM changes")
def changes_source(spark, folder):
    target = new_folder(spark, "changes")
    feed = tables.change_columns(_event_stream(spark, folder))
    query = (
        feed.select("seq", "kind", "path", "is_dir", "size", "modified")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{target}/rows")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{target}/rows")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{folder}/events.parquet"
    reader = spark.readStream.schema(tables.table(spark, folder, "events").schema)
    if is_folder(spark, place):
        return reader.parquet(place)
    return reader.option("pathGlobFilter", "events.parquet").parquet(folder)


# --- Ingest rules ------------------------------------------------------------

# Components of a path, the empty one before the leading slash left out.
_PIECES = "string_split(path, '/')[2:]"
_HIDDEN_DIR = (
    "(len(list_filter(string_split(path, '/')[1:-2], "
    "lambda x: length(x) > 1 AND left(x, 1) = '.')) > 0"
    " OR (is_dir AND length(name) > 1 AND left(name, 1) = '.'))"
)


def _register_excludes(name: str, where: str, excludes: Excludes, roots=("/",)) -> None:
    @register(
        name, f"SELECT path, is_dir FROM tree_entries_p WHERE NOT {_HIDDEN_DIR} AND ({where})"
    )
    def query(spark, folder):
        kept = apply_excludes(tables.tree_entries(spark, folder), excludes, roots)
        return kept.select("path", "is_dir")


_register_excludes("excl_hidden_dirs", "true", Excludes())
_register_excludes("excl_hidden_files", "left(name, 1) <> '.'", Excludes(skip_hidden=True))
_register_excludes(
    "excl_system", f"({_PIECES})[1] NOT IN ('proc', 'sys', 'dev')", Excludes(skip_system_paths=True)
)
_register_excludes(
    "excl_paths",
    "NOT (path = '/home/u3' OR path LIKE '/home/u3/%' OR path = '/home/u1/src'"
    " OR path LIKE '/home/u1/src/%')",
    Excludes(paths=("/home/u3", "/home/u1/src/")),
)
_register_excludes(
    "excl_patterns",
    f"len(list_filter({_PIECES}, lambda x: x LIKE '%.tmp' OR x LIKE 'doc\\__.%' ESCAPE '\\')) = 0",
    Excludes(patterns=("*.tmp", "doc_?.*")),
)
_register_excludes(
    "excl_folders",
    f"len(list_filter({_PIECES}, lambda x: x = 'node_modules' OR x LIKE 'x.%')) = 0",
    Excludes(folders=("**/node_modules", "x.*")),
)
_register_excludes(
    "excl_include_only",
    "regexp_matches(path, '^/home/u[0-9]+/') AND "
    f"len(list_filter(({_PIECES})[3:], lambda x: NOT (x LIKE '%.rs' OR x = 'docs'))) = 0",
    Excludes(include_only=("*.rs", "docs")),
    roots=tuple(f"/home/u{i}" for i in range(20)),
)

# --- Derived columns and lookups ---------------------------------------------


@register(
    "derive_parts",
    " UNION ALL ".join(
        f"SELECT path, name, parent, extension, name_lc FROM {v}_p"
        for v in ("doc_entries", "part_entries", "page_entries")
    ),
)
def derive_parts(spark, folder):
    views = [tables.doc_entries, tables.part_entries, tables.page_entries]
    docs, parts, pages = [
        with_parts(view(spark, folder)).select("path", *PART_FIELDS) for view in views
    ]
    return docs.unionByName(parts).unionByName(pages)


RESULT_SQL = "path, name, parent, extension, is_dir, size, modified, created, accessed"


@register("result_rows", f"SELECT {RESULT_SQL} FROM doc_entries_p")
def result_rows(spark, folder):
    return search(tables.doc_entries(spark, folder)).matched


@register(
    "desktop_rows",
    "SELECT path, name, parent, extension, is_dir, size, modified, true AS size_indexed "
    "FROM doc_entries_p ORDER BY modified DESC, path LIMIT 10000",
)
def desktop(spark, folder):
    found = search(tables.doc_entries(spark, folder), sort="modified-desc")
    return desktop_rows(found, limit=10_000)


@register(
    "lookup_path",
    f"SELECT {ENTRY_SQL} FROM order_entries WHERE path = "
    "(SELECT max(path) FROM order_entries)",
)
def lookup_path(spark, folder):
    orders = tables.order_entries(spark, folder)
    return lookup(orders, orders.agg(F.max("path")).first()[0])


# --- Search criteria ---------------------------------------------------------


def _register_search(name: str, view: str, where: str, terms=(), **wanted) -> None:
    @register(name, f"SELECT path, size FROM {view}_p WHERE {where}")
    def query(spark, folder):
        entries = getattr(tables, view)(spark, folder)
        return matches(entries, terms=terms, **wanted).select("path", "size")


_register_search("f_all", "doc_entries", "true")
_register_search("f_files", "doc_entries", "NOT is_dir", files=True)
_register_search("f_folders", "doc_entries", "is_dir", folders=True)
_register_search("f_files_and_folders", "doc_entries", "false", files=True, folders=True)
_register_search("f_ext", "doc_entries", "extension IN ('mkv', 'gz')", ext=" MKV; gz;;")
_register_search("f_ext_lines", "line_entries", "extension IN ('jpg', 'csv')", ext=["jpg", "csv"])
for _type, _extensions in filetypes.FILE_TYPES.items():
    _listed = ", ".join(f"'{e}'" for e in _extensions)
    _register_search(
        f"f_macro_{_type}",
        "typed_entries",
        f"NOT is_dir AND extension IN ({_listed})",
        file_type=_type,
    )
_register_search("f_path", "doc_entries", "contains(lower(path), 'src1/')", path="SRC1/")
_register_search("f_path_case", "doc_entries", "false", path="SRC1/", match_case=True)
_register_search(
    "f_path_case_hit", "doc_entries", "contains(path, 'src1/')", path="src1/", match_case=True
)
_register_search(
    "f_path_term",
    "doc_entries",
    "contains(path, '/en/') AND contains(name_lc, 'doc_1')",
    "doc_1",
    path="/en/",
    match_path=False,
)
_register_search(
    "f_size_range", "line_entries", "size BETWEEN 10000 AND 20000", size="10kb..20kb"
)
_register_search("f_size_gt", "line_entries", "size >= 102401", size=">small")
_register_search("f_size_ge", "line_entries", "size >= 50000", size=">= 50 kb")
_register_search("f_size_lt", "line_entries", "size < 10240", size="<tiny")
_register_search("f_size_le", "line_entries", "size <= 5000", size="<=5000")
_register_search("f_size_eq", "part_entries", "size = 10240", size="tiny")
_register_search(
    "f_modified_day",
    "line_entries",
    "modified BETWEEN 852076800 AND 852076800 + 86399",
    modified="1997-1-1",
)
_register_search(
    "f_modified_today",
    "doc_entries",
    "modified // 86400 = 1705276800 // 86400",
    modified="today",
    now=1_705_276_800 + 5_000,
)
_register_search(
    "f_created_day",
    "doc_entries",
    "created >= epoch(TIMESTAMP '2023-12-20') AND created < epoch(TIMESTAMP '2023-12-21')",
    created="2023-12-20",
)
_register_search(
    "f_accessed_day",
    "doc_entries",
    "accessed >= epoch(TIMESTAMP '2024-01-09') AND accessed < epoch(TIMESTAMP '2024-01-10')",
    accessed="2024-01-09",
)
_register_search("f_attrib_dir", "doc_entries", "is_dir", attrib="rhd")

# --- Text terms --------------------------------------------------------------

_register_search("t_substr", "part_entries", "contains(name_lc, 'ring_1')", "RING_1")
_register_search("t_substr_lines", "line_entries", "contains(name_lc, 'ne_3.z')", "ne_3.Z")
_register_search(
    "t_substr_case", "doc_entries", "contains(name, '.MKV')", [Substring(".MKV")], match_case=True
)
_register_search(
    "t_substr_path",
    "part_entries",
    "contains(lower(path), 'brand#12/s')",
    "BRAND#12/S",
    match_path=True,
)
_register_search("t_substr_empty", "part_entries", "true", [Substring("")])
_WORDS = "regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}_]+')"
_register_search(
    "t_word",
    "part_entries",
    f"list_contains({_WORDS.format('name_lc')}, 'small')",
    "Small",
    whole_word=True,
)
_register_search(
    "t_word_path",
    "doc_entries",
    f"list_contains({_WORDS.format('lower(path)')}, 'src7')",
    "SRC7",
    whole_word=True,
    match_path=True,
)
_register_search(
    "t_word_hit",
    "part_entries",
    "regexp_matches(name_lc, '(^|[^a-z0-9_])small([^a-z0-9_]|$)')",
    "Small",
    whole_word=True,
)
_register_search("t_word_never", "part_entries", "false", "small ring", whole_word=True)
_register_search(
    "t_glob", "part_entries", "name_lc LIKE '%r_ng\\_%9.small' ESCAPE '\\'", "R?ng_*9.SMALL"
)
_register_search("t_glob_open_end", "part_entries", "contains(name_lc, 'ring_1')", "ring_1*")
_register_search("t_glob_quirk", "part_entries", "false", "*?mall")
_register_search(
    "t_glob_quirk_hit",
    "asked_entries",
    "name_lc LIKE '%?ring\\_%9' ESCAPE '\\'",
    "*?ring_*9",
)
_register_search(
    "t_glob_whole",
    "part_entries",
    "name_lc LIKE 's%_ring\\_%.economy' ESCAPE '\\'",
    [Glob("s*l ring_*.economy")],
    whole_filename=True,
)
_register_search(
    "t_glob_whole_case",
    "doc_entries",
    "name LIKE '%.MKV'",
    "*.MKV",
    whole_filename=True,
    match_case=True,
)
_register_search(
    "t_glob_word",
    "part_entries",
    f"len(list_filter({_WORDS.format('name_lc')}, lambda w: w LIKE 'r__g\\_%7' ESCAPE '\\')) > 0",
    "r??g_*7",
    whole_word=True,
)
_register_search(
    "t_regex",
    "part_entries",
    "regexp_matches(name_lc, '^(red|blue) [a-z]+_[0-9]{2,3}[.]s')",
    [Regex(r"^(red|blue) [a-z]+_\d{2,3}\.s")],
)
_register_search(
    "t_regex_capital_hit",
    "doc_entries",
    "regexp_matches(path, '(MKV|PDF)$')",
    [Regex("(MKV|PDF)$")],
    match_case=True,
)
_register_search("t_regex_capital", "part_entries", "false", [Regex("^Red")])
_register_search(
    "t_regex_case",
    "doc_entries",
    "regexp_matches(name, '[0-9]*7[.][A-Z]{3}$')",
    [Regex(r"\d*7\.[A-Z]{3}$")],
    match_case=True,
)
_register_search(
    "t_regex_word",
    "part_entries",
    f"len(list_filter({_WORDS.format('name_lc')}, "
    "lambda w: regexp_full_match(w, 'ring_[0-9]|widget_[0-9]+5'))) > 0",
    [Regex(r"ring_\d|widget_\d+5")],
    whole_word=True,
)
_register_search(
    "t_or",
    "part_entries",
    "contains(name_lc, 'anvil') OR contains(name_lc, 'gizmo') OR name_lc LIKE '%7.large'",
    "anvil||gizmo|*7.large",
)
_register_search("t_not", "part_entries", "NOT contains(name_lc, 'ring')", [Not(Substring("ring"))])
_register_search(
    "t_and",
    "part_entries",
    "contains(name_lc, 'red') AND contains(name_lc, '_19') AND size > 10000 AND "
    "(contains(name_lc, 'rod') OR regexp_matches(name_lc, 'g(ea|izm)'))",
    ["red", "_19", AnyOf("rod", Regex("g(ea|izm)"))],
    size=">10000",
)


@register("t_prefix", "SELECT path, size FROM part_entries_p WHERE starts_with(name_lc, 'blue r')")
def t_prefix(spark, folder):
    return name_starts_with(tables.part_entries(spark, folder), "BLUE r").select("path", "size")


# --- Subtrees ----------------------------------------------------------------

def _txt_folders(spark, folder):
    found = matches(tables.doc_entries(spark, folder), ext="txt", size=">10kb")
    return found.select(F.col("parent").alias("path"))


_TXT_SQL = (
    "SELECT DISTINCT parent AS p FROM doc_entries_p WHERE extension = 'txt' AND size > 10000"
)


@register(
    "under_prefix",
    f"SELECT path, is_dir FROM doc_entries e WHERE EXISTS (SELECT 1 FROM ({_TXT_SQL}) f "
    "WHERE e.path = f.p OR starts_with(e.path, f.p || '/'))",
)
def under_prefix(spark, folder):
    entries = tables.doc_entries(spark, folder)
    return hierarchy.under(entries, _txt_folders(spark, folder)).select("path", "is_dir")


@register(
    "cascade_delete",
    f"""SELECT path, is_dir, size FROM user_entries e WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT DISTINCT path AS p FROM changes WHERE kind = 'delete') d
          WHERE e.path = d.p OR starts_with(e.path, d.p || '/'))""",
)
def cascade_delete(spark, folder):
    deletes = tables.changes(spark, folder).filter("kind = 'delete'")
    kept = hierarchy.not_under(tables.user_entries(spark, folder), deletes)
    return kept.select("path", "is_dir", "size")


# --- Totals ------------------------------------------------------------------


@register(
    "total_count",
    "SELECT count(*) AS total_count FROM line_entries_p WHERE contains(name_lc, '.zip')",
)
def total_count(spark, folder):
    return search(tables.line_entries(spark, folder), ".zip").totals.select("total_count")


@register(
    "total_size",
    "SELECT count(*) AS total_count, sum(size)::BIGINT AS total_size FROM doc_entries",
)
def total_size(spark, folder):
    return search(tables.doc_entries(spark, folder)).totals


@register("entry_count", "SELECT count(*) AS n FROM line_entries")
def entry_count(spark, folder):
    return tables.line_entries(spark, folder).agg(F.count(F.lit(1)).alias("n"))


@register(
    "ext_counts",
    """SELECT extension, count(*) AS n_files FROM (
         SELECT extension, is_dir FROM doc_entries_p
         UNION ALL SELECT extension, is_dir FROM line_entries_p)
       WHERE NOT is_dir GROUP BY extension""",
)
def ext_counts(spark, folder):
    both = tables.doc_entries(spark, folder).unionByName(tables.line_entries(spark, folder))
    return totals.extension_counts(both)


@register("ext_postings", "SELECT extension, path FROM doc_entries_p WHERE NOT is_dir")
def ext_postings(spark, folder):
    return totals.extension_postings(tables.doc_entries(spark, folder))


# --- Order and pages ---------------------------------------------------------

for _key in ("name", "path", "size", "modified", "created", "accessed", "ext"):
    for _direction in ("asc", "desc"):
        _column = "extension" if _key == "ext" else _key
        _tie = "" if _key == "path" else ", path"

        @register(
            f"sort_{_key}_{_direction}",
            f"SELECT path, row_number() OVER (ORDER BY {_column} {_direction}{_tie}) AS position "
            "FROM doc_entries_p",
        )
        def sorted_query(spark, folder, sort=f"{_key}-{_direction}"):
            entries = with_parts(tables.doc_entries(spark, folder))
            placed = sorting.with_position(entries, *sorting.sort_order(sort))
            return placed.select("path", "position")


@register(
    "page_offset_limit",
    "SELECT path, size FROM part_entries_p WHERE contains(name_lc, 'ring') "
    "ORDER BY size DESC, path LIMIT 40 OFFSET 25",
)
def page_offset_limit(spark, folder):
    entries = tables.part_entries(spark, folder)
    found = search(entries, "ring", sort="size-desc", offset=25, limit=40)
    return found.page.select("path", "size")


@register(
    "page_deep", "SELECT path, size FROM order_entries ORDER BY size, path LIMIT 400 OFFSET 10000"
)
def page_deep(spark, folder):
    found = search(tables.order_entries(spark, folder), sort="size", offset=10_000, limit=400)
    return found.page.select("path", "size")


@register(
    "page_deep_totals",
    """SELECT path, size, (SELECT count(*) FROM order_entries) AS total_count,
              (SELECT sum(size)::BIGINT FROM order_entries) AS total_size
       FROM order_entries ORDER BY size DESC, path LIMIT 300 OFFSET 12000""",
)
def page_deep_totals(spark, folder):
    """The counts that find the page give the totals too."""
    found = search(tables.order_entries(spark, folder), sort="size-desc", offset=12_000, limit=300)
    return found.page_with_totals.select("path", "size", "total_count", "total_size")


@register(
    "page_past_end", "SELECT path, size FROM order_entries LIMIT 10 OFFSET 1000000000"
)
def page_past_end(spark, folder):
    found = search(tables.order_entries(spark, folder), offset=1_000_000_000, limit=10)
    return found.page.select("path", "size")


@register("topk_size", "SELECT path, size FROM line_entries ORDER BY size DESC, path LIMIT 100")
def topk_size(spark, folder):
    found = search(tables.line_entries(spark, folder), sort="size-desc", limit=100)
    return found.page.select("path", "size")


@register(
    "page_with_totals",
    """SELECT path, name, size,
              (SELECT count(*) FROM doc_entries_p WHERE contains(name_lc, 'doc_2')) AS total_count,
              (SELECT sum(size)::BIGINT FROM doc_entries_p WHERE contains(name_lc, 'doc_2'))
                AS total_size
       FROM doc_entries_p WHERE contains(name_lc, 'doc_2')
       ORDER BY modified DESC, path LIMIT 20 OFFSET 5""",
)
def page_with_totals(spark, folder):
    entries = tables.doc_entries(spark, folder)
    found = search(entries, "DOC_2", sort="date-modified-desc", offset=5, limit=20)
    return found.page_with_totals.select("path", "name", "size", "total_count", "total_size")


@register(
    "page_after",
    """SELECT path, size FROM order_entries_p
       WHERE size < 150000 OR (size = 150000 AND path > '/archive/c_1')
       ORDER BY size DESC, path LIMIT 50""",
)
def page_after(spark, folder):
    found = search(tables.order_entries(spark, folder), sort="size-desc")
    return found.page_after((150_000, "/archive/c_1"), 50).select("path", "size")


# --- Grams -------------------------------------------------------------------

_GRAMS_SQL = (
    "SELECT DISTINCT path, unnest(list_transform(range(1, greatest(length(name_lc) - 1, 1)), "
    "lambda i: substring(name_lc, i, 3))) AS gram FROM {}"
)


@register("name_grams", f"SELECT path, gram FROM ({_GRAMS_SQL.format('part_entries_p')})")
def name_grams(spark, folder):
    return grams.name_grams(tables.part_entries(spark, folder)).select("path", "gram")


def _indexed(spark: SparkSession, entries: DataFrame) -> tuple[DataFrame, grams.GramIndex]:
    """The entries as a saved catalogue, in several buckets, with its index."""
    target = new_folder(spark, "grams")
    catalogue.save_catalogue(entries, target, partitions=8)
    return catalogue.load_catalogue(spark, target), grams.save_grams(spark, target)


@register("gram_postings", f"SELECT gram, path FROM ({_GRAMS_SQL.format('order_entries_p')})")
def gram_postings(spark, folder):
    return grams.name_grams(tables.order_entries(spark, folder))


@register(
    "gram_counts",
    f"SELECT gram, count(*) AS n FROM ({_GRAMS_SQL.format('part_entries_p')}) GROUP BY gram",
)
def gram_counts(spark, folder):
    return grams.gram_counts(grams.name_grams(tables.part_entries(spark, folder)))


@register(
    "gram_candidates",
    f"""SELECT path FROM ({_GRAMS_SQL.format('part_entries_p')})
        WHERE gram IN ('sma', 'mal', 'all', 'll ', 'l r', ' ri', 'rin', 'ing')
        GROUP BY path HAVING count(*) = 8""",
)
def gram_candidates(spark, folder):
    postings = grams.name_grams(tables.part_entries(spark, folder))
    return grams.gram_candidates(postings, "Small ring")


@register(
    "gram_search", f"SELECT {ENTRY_SQL} FROM part_entries_p WHERE contains(name_lc, 'ring_19')"
)
def gram_search(spark, folder):
    entries, index = _indexed(spark, tables.part_entries(spark, folder))
    return grams.gram_search(entries, index, "Ring_19").select(*ENTRY_FIELDS)


@register(
    "gram_search_subset",
    f"SELECT {ENTRY_SQL} FROM part_entries_p WHERE contains(name_lc, 'ring_1') AND size > 20480",
)
def gram_search_subset(spark, folder):
    """Only what is in the given entries can be found."""
    entries, index = _indexed(spark, tables.part_entries(spark, folder))
    some = entries.filter(F.col("size") > 20480)
    return grams.gram_search(some, index, "Ring_1").select(*ENTRY_FIELDS)


@register(
    "gram_search_after_changes",
    """SELECT path, size FROM part_entries_p
       WHERE contains(name_lc, 'ring_1') AND NOT contains(name_lc, 'ring_11')
       UNION ALL
       SELECT '/new/ring_1_' || p_partkey, p_partkey FROM part WHERE p_partkey % 20 = 0""",
)
def gram_search_after_changes(spark, folder):
    """An index of the version before still gives the answer of the entries after."""
    parts = tables.part_entries(spark, folder)
    target = new_folder(spark, "grams")
    catalogue.save_catalogue(parts, target, partitions=8)
    index = grams.save_grams(spark, target)
    new = tables.table(spark, folder, "part").filter("p_partkey % 20 = 0")
    key = F.col("p_partkey").cast("bigint")
    columns = {"kind": F.lit("create"), "size": key, "seq": key}
    new = new.withColumns(columns).withColumn("path", F.concat(F.lit("/new/ring_1_"), key))
    gone = parts.filter(F.lower("path").contains("ring_11")).withColumns(
        {"kind": F.lit("delete"), "seq": F.lit(0).cast("bigint")}
    )
    events = ch.as_changes(new).unionByName(ch.as_changes(gone))
    catalogue.save_catalogue(ch.apply_changes(parts, events), target)
    entries = catalogue.load_catalogue(spark, target)
    return grams.gram_search(entries, index, "Ring_1").select("path", "size")


@register(
    "gram_search_ext",
    f"SELECT {ENTRY_SQL} FROM order_entries_p WHERE contains(name_lc, '0012') "
    "AND extension = 'txt' AND size > 100000 AND NOT contains(name_lc, '7')",
)
def gram_search_ext(spark, folder):
    entries, index = _indexed(spark, tables.order_entries(spark, folder))
    wanted = {"terms": ["0012", Not(Substring("7"))], "ext": "txt", "size": ">100kb"}
    return grams.seeded_matches(entries, index, **wanted).select(*ENTRY_FIELDS)


@register(
    "prefix_buckets",
    "SELECT left(name_lc, 1) AS first_char, count(*) AS n FROM part_entries_p "
    "WHERE name_lc <> '' GROUP BY 1",
)
def prefix_buckets(spark, folder):
    return grams.prefix_buckets(tables.part_entries(spark, folder))


_OLD_SQL = """(SELECT path, is_dir, arg_max(size, o) AS size, arg_max(modified, o) AS modified,
                      arg_max(created, o) AS created, arg_max(accessed, o) AS accessed
               FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_extendedprice, l_partkey,
                              l_suppkey, l_quantity, l_discount, l_tax) AS o
                     FROM line_rows WHERE {where})
               GROUP BY path, is_dir)"""
_BEFORE = _OLD_SQL.format(where="l_shipdate < DATE '1999-01-01'")
_AFTER = _OLD_SQL.format(where="l_shipdate >= DATE '1997-01-01'")


def _lines_between(spark, folder, first=None, last=None):
    """The catalogue of the lines shipped in a period, the last one of each path."""
    rows = tables.line_rows(spark, folder)
    if first:
        rows = rows.filter(F.col("l_shipdate") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        rows = rows.filter(F.col("l_shipdate") < F.lit(last).cast("timestamp_ntz"))
    return ch.latest_by_path(rows, *map(F.col, tables.LINE_ORDER)).select(*ENTRY_FIELDS)


@register(
    "gram_postings_refresh",
    f"""WITH before AS {_BEFORE}, after AS {_AFTER},
          parts AS (SELECT path, lower(string_split(path, '/')[-1]) AS name_lc FROM after)
        SELECT gram, path FROM ({_GRAMS_SQL.format('parts')})""",
)
def gram_postings_refresh(spark, folder):
    # Each is read several times.
    before = written(_lines_between(spark, folder, last="1999-01-01"), "before")
    after = written(_lines_between(spark, folder, first="1997-01-01"), "after")
    diff = written(reconcile.reconcile_diff(before, after), "diff")
    added = after.join(diff.filter("status IN ('added', 'changed')"), "path", "left_semi")
    removed = diff.filter("status = 'removed'")
    return grams.refresh_postings(grams.name_grams(before), removed, added)


# --- Changes -----------------------------------------------------------------


@register("latest_by_path", f"SELECT {ENTRY_SQL} FROM {_OLD_SQL.format(where='true')}")
def latest_by_path(spark, folder):
    return _lines_between(spark, folder)


@register(
    "reconcile_diff",
    f"""WITH before AS {_BEFORE}, after AS {_AFTER}
        SELECT coalesce(b.path, a.path) AS path,
               CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
                    WHEN (b.size, b.modified) = (a.size, a.modified) THEN 'same'
                    ELSE 'changed' END AS status,
               b.size AS old_size, a.size AS new_size
        FROM before b FULL JOIN after a ON a.path = b.path""",
)
def reconcile_diff(spark, folder):
    before = _lines_between(spark, folder, last="1999-01-01")
    return reconcile.reconcile_diff(before, _lines_between(spark, folder, first="1997-01-01"))


@register(
    "reconcile_stale",
    f"""WITH before AS {_BEFORE}, after AS {_AFTER}
        SELECT {ENTRY_SQL} FROM before WHERE path NOT IN (SELECT path FROM after)""",
)
def reconcile_stale(spark, folder):
    before = _lines_between(spark, folder, last="1999-01-01")
    return reconcile.stale(before, _lines_between(spark, folder, first="1997-01-01"))


@register(
    "reconcile_upsert",
    f"""WITH before AS {_BEFORE}, after AS {_AFTER}
        SELECT {ENTRY_SQL} FROM after
        UNION ALL
        SELECT {ENTRY_SQL} FROM before WHERE path NOT IN (SELECT path FROM after)""",
)
def reconcile_upsert(spark, folder):
    before = _lines_between(spark, folder, last="1999-01-01")
    return reconcile.upsert(before, _lines_between(spark, folder, first="1997-01-01"))


_STEPS = """
    SELECT seq * 2 AS ord, CASE kind WHEN 'move' THEN 'delete' ELSE kind END AS kind, path,
           is_dir, size, modified FROM {events}
    UNION ALL
    SELECT seq * 2 + 1, 'create', to_path, is_dir, size, modified FROM {events}
    WHERE kind = 'move'"""

_FOLD = """
    WITH steps AS ({steps}),
    kills AS (SELECT path AS k, max(ord) AS ord FROM steps WHERE kind = 'delete' GROUP BY path),
    rows AS (
      SELECT path, -1 AS ord, true AS creates, is_dir, size, modified, created, accessed
      FROM user_entries
      UNION ALL
      SELECT path, ord, kind = 'create', is_dir, size, modified,
             CASE kind WHEN 'create' THEN 0 END, CASE kind WHEN 'create' THEN 0 END
      FROM steps WHERE kind IN ('create', 'modify')),
    state AS (
      SELECT path, max(ord) FILTER (creates) AS born,
             arg_max(is_dir, ord) FILTER (creates) AS is_dir,
             arg_max(size, ord) FILTER (size IS NOT NULL) AS size,
             arg_max(modified, ord) FILTER (modified IS NOT NULL) AS modified,
             arg_max(created, ord) FILTER (created IS NOT NULL) AS created,
             arg_max(accessed, ord) FILTER (accessed IS NOT NULL) AS accessed
      FROM rows GROUP BY path),
    killed AS (
      SELECT s.path, max(k.ord) AS died FROM state s
      JOIN kills k ON s.path = k.k OR starts_with(s.path, k.k || '/') GROUP BY s.path)
    SELECT s.path, is_dir, size, modified, created::BIGINT AS created,
           accessed::BIGINT AS accessed
    FROM state s LEFT JOIN killed d ON d.path = s.path
    WHERE born IS NOT NULL AND born > coalesce(died, -2) {also}"""


@register("apply_changes", _FOLD.format(steps=_STEPS.format(events="changes"), also=""))
def apply_changes(spark, folder):
    base = tables.user_entries(spark, folder)
    return ch.apply_changes(base, tables.changes(spark, folder))


@register("apply_changes_moves", _FOLD.format(steps=_STEPS.format(events="feed"), also=""))
def apply_changes_moves(spark, folder):
    base = tables.user_entries(spark, folder)
    return ch.apply_changes(base, tables.changes(spark, folder, moves=True))


@register("apply_changes_shuffled", _FOLD.format(steps=_STEPS.format(events="feed"), also=""))
def apply_changes_shuffled(spark, folder):
    """The same answer by the plan for batches too large to broadcast."""
    base = tables.user_entries(spark, folder)
    return ch.apply_changes(base, tables.changes(spark, folder, moves=True), broadcast=False)


@register("stream_apply", _FOLD.format(steps=_STEPS.format(events="changes"), also=""))
def stream_apply(spark, folder):
    target = new_folder(spark, "stream")
    fold.start_catalogue(tables.user_entries(spark, folder), target)
    # The feed out of order, in several batches, folded into a new version now and then.
    feed = f"{new_folder(spark, 'feed')}/events.parquet"
    events = tables.table(spark, folder, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(feed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(feed)
    query = fold.fold_stream(tables.change_columns(stream), target, compact_every=2)
    query.awaitTermination()
    return fold.current_catalogue(spark, target).select(*ENTRY_FIELDS)


@register(
    "refresh_keeps_changes",
    _FOLD.format(
        steps=_STEPS.format(
            events="(SELECT * FROM changes WHERE seq > (SELECT max(seq) // 2 FROM changes))"
        ),
        also="",
    ),
)
def refresh_keeps_changes(spark, folder):
    """A listing that knows the first half of the events; the other half stays logged."""
    users, target = tables.user_entries(spark, folder), new_folder(spark, "refresh")
    fold.start_catalogue(users, target)
    query = fold.fold_stream(tables.change_columns(_event_stream(spark, folder)), target)
    query.awaitTermination()
    half = tables.changes(spark, folder).agg(F.max("seq")).first()[0] // 2
    refresh(spark, target, users, as_of_seq=half)
    return fold.current_catalogue(spark, target).select(*ENTRY_FIELDS)


# Every report travels on its own: to the next cut above its place, until there is none.
_CARRIED = f"""
    WITH RECURSIVE steps AS ({_STEPS.format(events="directory_feed")}),
    moves AS (SELECT seq * 2 AS ord, path AS source, to_path AS target
              FROM directory_feed WHERE kind = 'move' AND is_dir),
    deletes AS (SELECT ord, path FROM steps WHERE kind = 'delete'),
    rows AS (
      SELECT path, -1::BIGINT AS ord, true AS creates, is_dir, size, modified, created, accessed
      FROM user_entries
      UNION ALL
      SELECT path, ord, kind = 'create', is_dir, size, modified,
             CASE kind WHEN 'create' THEN 0 END, CASE kind WHEN 'create' THEN 0 END
      FROM steps WHERE kind IN ('create', 'modify')),
    places AS (SELECT DISTINCT path, ord FROM rows),
    first_cuts AS (
      SELECT path, ord, path AS loc, [ord] AS key,
             (SELECT min(m.ord) FROM moves m
              WHERE m.ord > p.ord AND starts_with(p.path, m.source || '/')) AS next
      FROM places p),
    travels AS (
      SELECT *, 0 AS ended FROM first_cuts
      UNION ALL
      SELECT t.path, t.ord, m.target || substr(t.loc, length(m.source) + 1) AS loc,
             list_prepend(m.ord + 1, t.key) AS key,
             (SELECT min(n.ord) FROM moves n
              WHERE n.ord > m.ord
                AND starts_with(m.target || substr(t.loc, length(m.source) + 1), n.source || '/')),
             0
      FROM travels t JOIN moves m ON m.ord = t.next
      WHERE NOT EXISTS (
        SELECT 1 FROM deletes d
        WHERE d.ord > t.key[1] AND d.ord < t.next
          AND (t.loc = d.path OR starts_with(t.loc, d.path || '/')))),
    there AS (
      SELECT t.loc, t.key, r.* FROM travels t JOIN rows r ON r.path = t.path AND r.ord = t.ord
      WHERE t.next IS NULL AND NOT EXISTS (
        SELECT 1 FROM deletes d
        WHERE d.ord > t.key[1] AND (t.loc = d.path OR starts_with(t.loc, d.path || '/')))),
    winners AS (
      SELECT loc, key, ord, is_dir FROM there WHERE creates
      QUALIFY row_number() OVER (PARTITION BY loc ORDER BY key DESC) = 1),
    reports AS (
      SELECT t.* FROM there t JOIN winners w ON t.loc = w.loc
      WHERE t.ord >= w.ord AND t.key[:-2] = list_filter(w.key[:-2], lambda m: m > t.ord))
    SELECT w.loc AS path, any_value(w.is_dir) AS is_dir,
           arg_max(r.size, r.ord) FILTER (r.size IS NOT NULL) AS size,
           arg_max(r.modified, r.ord) FILTER (r.modified IS NOT NULL) AS modified,
           arg_max(r.created, r.ord) FILTER (r.created IS NOT NULL)::BIGINT AS created,
           arg_max(r.accessed, r.ord) FILTER (r.accessed IS NOT NULL)::BIGINT AS accessed
    FROM winners w JOIN reports r ON r.loc = w.loc GROUP BY w.loc"""


@register("apply_directory_moves", _CARRIED)
def apply_directory_moves(spark, folder):
    """Moved directories take along what lives in them then."""
    base = tables.user_entries(spark, folder)
    return ch.apply_changes(base, tables.directory_changes(spark, folder))


@register("refresh_late_events", _FOLD.format(
    steps=_STEPS.format(events="(SELECT * FROM changes WHERE seq > (SELECT max(seq) // 2 FROM changes))"),
    also="",
))
def refresh_late_events(spark, folder):
    """A listing that knows the first half of the events, which arrive only after it."""
    users, target = tables.user_entries(spark, folder), new_folder(spark, "refresh")
    events = tables.table(spark, folder, "events")
    half = events.agg(F.max("event_id")).first()[0] // 2
    fold.start_catalogue(users, target)
    refresh(spark, target, users, as_of_seq=half)
    feed = f"{new_folder(spark, 'feed')}/events.parquet"
    for early in (False, True):
        part = events.filter((F.col("event_id") <= half) == early)
        part.coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(events.schema).parquet(feed)
        fold.fold_stream(tables.change_columns(stream), target, compact_every=1).awaitTermination()
    return fold.current_catalogue(spark, target).select(*ENTRY_FIELDS)


@register(
    "compact_touched_buckets",
    _FOLD.format(steps=_STEPS.format(events="changes"), also="").replace("user_entries", "all_entries").replace(
        "WITH steps AS", f"""WITH all_entries AS (
          SELECT * FROM user_entries UNION ALL SELECT {ENTRY_SQL} FROM order_entries), steps AS""", 1
    ),
)
def compact_touched_buckets(spark, folder):
    """The changes concern homes; buckets of the archive keep their files."""
    orders = tables.order_entries(spark, folder).select(*ENTRY_FIELDS)
    both, target = orders.unionByName(tables.user_entries(spark, folder)), new_folder(spark, "buckets")
    catalogue.save_catalogue(both, target, partitions=16, reason="start")
    stream = tables.change_columns(_event_stream(spark, folder))
    fold.fold_stream(stream, target, compact_every=1).awaitTermination()
    runs = {b["run"] for b in catalogue.latest_version(spark, target)["buckets"]}
    if len(runs) < 2 and not orders.isEmpty():
        raise RuntimeError("all buckets were written again")
    return catalogue.load_catalogue(spark, target).select(*ENTRY_FIELDS)


@register(
    "gram_search_with_log",
    _FOLD.format(steps=_STEPS.format(events="changes"), also="AND contains(lower(string_split(s.path, '/')[-1]), 'f_1')"),
)
def gram_search_with_log(spark, folder):
    """Stored buckets are found by their grams, paths that are new in the log beside them."""
    target = new_folder(spark, "grams-log")
    catalogue.save_catalogue(tables.user_entries(spark, folder), target, partitions=8, reason="start")
    index = grams.save_grams(spark, target)
    fold.fold_stream(tables.change_columns(_event_stream(spark, folder)), target).awaitTermination()
    now = fold.current_catalogue(spark, target)
    return grams.gram_search(now, index, "F_1").select(*ENTRY_FIELDS)


@register(
    "standing_search",
    _FOLD.format(steps=_STEPS.format(events="changes"), also="AND size > 300"),
)
def standing_search(spark, folder):
    """The answer of a standing search after the last of several batches."""
    target = new_folder(spark, "standing")
    fold.start_catalogue(tables.user_entries(spark, folder), target)
    feed = f"{new_folder(spark, 'feed')}/events.parquet"
    events = tables.table(spark, folder, "events")
    events.repartition(2, F.xxhash64("event_id")).write.parquet(feed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(feed)
    searches = {"large": {"size": ">300", "sort": "size-desc"}}
    fold.fold_stream(tables.change_columns(stream), target, searches=searches).awaitTermination()
    answers = spark.read.parquet(f"{target}/searches/large")
    last = answers.filter(F.col("batch") == answers.select(F.max("batch")).scalar())
    return last.select(*ENTRY_FIELDS)


@register(
    "overflow_rebuild",
    _FOLD.format(
        steps=_STEPS.format(
            events="(SELECT * FROM feed WHERE kind <> 'overflow' AND seq % 500 <> 0 "
            "AND seq > (SELECT max(seq) // 2 FROM feed))"
        ),
        also="",
    ),
)
def overflow_rebuild(spark, folder):
    """Lost events cause a rebuild from a listing; only later events act on it."""
    users, target = tables.user_entries(spark, folder), new_folder(spark, "overflow")
    fold.start_catalogue(users, target)
    half = tables.changes(spark, folder).agg(F.max("seq")).first()[0] // 2
    stream = tables.change_columns(_event_stream(spark, folder), moves=True)
    stream = stream.withColumn("kind", F.when(F.col("seq") % 500 == 0, "overflow").otherwise(F.col("kind")))
    fold.fold_stream(stream, target, relist=lambda: (users, half)).awaitTermination()
    return fold.current_catalogue(spark, target).select(*ENTRY_FIELDS)


@register(
    "moves_split",
    f"SELECT ord, kind, path, is_dir, size, modified FROM ({_STEPS.format(events='feed')})",
)
def moves_split(spark, folder):
    steps = ch.split_moves(tables.changes(spark, folder, moves=True))
    return steps.select("ord", "kind", "path", "is_dir", "size", "modified")


@register(
    "changes_scoped",
    f"""SELECT ord, kind, path FROM ({_STEPS.format(events='feed')})
        WHERE regexp_matches(path, '^/u/([0-3]|1[0-9])(/|$)')
          AND NOT regexp_matches(path, '^/u/(2|15)(/|$)')""",
)
def changes_scoped(spark, folder):
    roots = tuple(f"/u/{i}" for i in (*range(4), *range(10, 20)))
    steps = ch.split_moves(tables.changes(spark, folder, moves=True))
    scoped = ch.in_scope(steps, ch.Scope(roots, own_folders=("/u/2", "/u/15")))
    return scoped.select("ord", "kind", "path")


# --- Export ------------------------------------------------------------------

_LISTED = "SELECT path FROM doc_entries_p WHERE contains(name_lc, '7') AND size > 1000"


def _exported(spark, folder, format, **options):
    found = search(tables.doc_entries(spark, folder), "7", size=">1000", sort="path")
    target = new_folder(spark, f"export-{format}")
    export(found.page, format, target, **options)
    return target


@register("export_csv", _LISTED)
def export_csv(spark, folder):
    """What was written is read again, its header and quotes with it."""
    target = _exported(spark, folder, "csv")
    lines = spark.read.option("lineSep", "\r\n").text(target)
    return lines.filter("value <> '\"Name\"'").select(F.expr("substring(value, 2, length(value) - 2)").alias("path"))


@register("export_tsv", "SELECT 'Name' AS line UNION ALL SELECT path FROM (" + _LISTED + ")")
def export_tsv(spark, folder):
    return spark.read.text(_exported(spark, folder, "tsv")).withColumnRenamed("value", "line")


@register("export_txt", _LISTED)
def export_txt(spark, folder):
    return spark.read.text(_exported(spark, folder, "txt")).withColumnRenamed("value", "path")


@register("export_efu", _LISTED)
def export_efu(spark, folder):
    target = _exported(spark, folder, "efu", header=False, on_empty="hide")
    return spark.read.text(target).withColumnRenamed("value", "path")


@register(
    "symlinks_dropped",
    "SELECT path, size FROM doc_entries WHERE is_dir OR size % 3 <> 0",
)
def symlinks_dropped(spark, folder):
    listing = tables.doc_entries(spark, folder)
    link = (F.col("size") % 3 == 0) & ~F.col("is_dir")
    return build_catalogue(listing.withColumn("is_symlink", link)).select("path", "size")


@register(
    "scan_count",
    "SELECT count(DISTINCT path) AS entries FROM line_entries",
)
def scan_count(spark, folder):
    """What a build has counted while it saved."""
    target = new_folder(spark, "scan")
    stats, _ = refresh(spark, target, tables.line_entries(spark, folder))
    return spark.createDataFrame([(stats.entries,)], "entries long")


# --- Monitoring --------------------------------------------------------------


@register(
    "status_row",
    """SELECT (SELECT count(*) FROM user_entries) AS entry_count,
              'Indexed ' || (SELECT count(*) FROM user_entries) || ' entries' AS message,
              count(*) AS event_count,
              count(*) FILTER (kind = 'overflow') AS overflow_count,
              0::BIGINT AS watch_failure_count,
              count(*) FILTER (kind = 'overflow') = 0 AS healthy,
              floor(epoch(max(ts)))::BIGINT AS last_updated
       FROM feed""",
)
def status_row(spark, folder):
    feed = tables.changes(spark, folder, moves=True)
    return monitor.status_row(tables.user_entries(spark, folder), feed)


@register(
    "change_log_tail",
    """SELECT seq, CASE kind WHEN 'move' THEN 'move ' || path || ' -> ' || to_path
                             ELSE kind || ' ' || path END AS text
       FROM feed ORDER BY seq DESC LIMIT 50""",
)
def change_log_tail(spark, folder):
    return monitor.change_log_tail(tables.changes(spark, folder, moves=True))


@register(
    "changes_per_day",
    "SELECT ts::DATE AS day, kind, count(*) AS n FROM feed GROUP BY 1, 2",
)
def changes_per_day(spark, folder):
    return monitor.changes_per_day(tables.changes(spark, folder, moves=True))


# --- Scalar functions --------------------------------------------------------


@register(
    "name_words",
    f"SELECT path, array_to_string(list_filter({_WORDS.format('name_lc')}, "
    "lambda w: w <> ''), ' ') AS words FROM part_entries_p",
)
def name_words(spark, folder):
    parts = with_parts(tables.part_entries(spark, folder))
    return parts.select("path", F.array_join(words.words(F.col("name_lc")), " ").alias("words"))


@register(
    "parse_size_col",
    """SELECT p_partkey,
              CASE p_partkey % 8 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000000
                   WHEN 2 THEN p_size::BIGINT * 1000000000 WHEN 3 THEN 10240
                   WHEN 4 THEN 134217729 WHEN 5 THEN NULL WHEN 6 THEN NULL
                   ELSE p_size END::BIGINT AS bytes
       FROM part""",
)
def parse_size_col(spark, folder):
    number, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    text = (
        F.when(kind == 0, F.concat(number, F.lit(" kb")))
        .when(kind == 1, F.concat(number, F.lit("MB ")))
        .when(kind == 2, F.concat(number, F.lit("gb")))
        .when(kind == 3, F.lit("Tiny"))
        .when(kind == 4, F.lit("gigantic"))
        .when(kind == 5, F.concat(number, F.lit(".5kb")))
        .when(kind == 6, F.concat(number, F.lit("tb")))
        .otherwise(number)
    )
    parts = tables.table(spark, folder, "part")
    return parts.select("p_partkey", sizes.size_of_text(text).alias("bytes"))


@register(
    "day_bounds",
    """SELECT DISTINCT strftime(l_shipdate, '%Y-%-m-%-d') AS text,
              epoch(date_trunc('day', l_shipdate))::BIGINT AS first_second,
              epoch(date_trunc('day', l_shipdate))::BIGINT + 86399 AS last_second,
              year(l_shipdate) % 4 = 0 AS leap
       FROM lineitem""",
)
def day_bounds(spark, folder):
    text = F.date_format("l_shipdate", "y-M-d")
    start = dates.day_start_of_text(text)
    leap_day = F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("-2-29"))
    noon = F.unix_timestamp("l_shipdate") + 43_200
    rows = tables.table(spark, folder, "lineitem").select(
        text.alias("text"),
        start.alias("first_second"),
        dates.end_of_day(noon).alias("last_second"),
        dates.day_start_of_text(leap_day).isNotNull().alias("leap"),
    )
    return rows.distinct()


_SIZES_SQL = """
    (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
            floor(l_extendedprice)::BIGINT *
              CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 64 WHEN 3 THEN 2816 WHEN 4 THEN 300007
                   WHEN 5 THEN 123456789 WHEN 6 THEN 100000000000 ELSE 0 END // 7 AS size
     FROM lineitem)"""


def _sizes(spark, folder):
    factor = F.lit(0).cast("bigint")
    factors = (1, 64, 2816, 300_007, 123_456_789, 100_000_000_000)
    for line, value in enumerate(factors, start=1):
        this = F.lit(value).cast("bigint")
        factor = F.when(F.col("l_linenumber") == line, this).otherwise(factor)
    size = F.call_function("div", F.floor("l_extendedprice").cast("bigint") * factor, F.lit(7))
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size.alias("size")
    )


def _units_sql(whole: str, number: str) -> str:
    cases = " ".join(
        f"WHEN size < 1024::HUGEINT ** {i + 1} "
        f"THEN {number.format(unit=f'1024.0 ** {i}')} || ' {unit}'"
        for i, unit in enumerate(("KB", "MB", "GB", "TB"), start=1)
    )
    last = number.format(unit="1024.0 ** 5")
    return f"CASE WHEN size < 1024 THEN {whole} {cases} ELSE {last} || ' PB' END"


_EVEN = "printf('%.1f', size::DOUBLE / ({unit}))"
_UP = "printf('%.1f', floor(size::DOUBLE / ({unit}) * 10 + 0.5) / 10)"


@register(
    "format_size",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, size,
               {_units_sql("size || ' B'", _EVEN)} AS shown FROM {_SIZES_SQL}""",
)
def format_size(spark, folder):
    return _sizes(spark, folder).withColumn("shown", sizes.format_size(F.col("size")))


_UI_WHOLE = "CASE size WHEN 0 THEN '0 B' ELSE size || '.0 B' END"


@register(
    "format_size_ui",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, size,
               {_units_sql(_UI_WHOLE, _UP)} AS shown FROM {_SIZES_SQL}""",
)
def format_size_ui(spark, folder):
    return _sizes(spark, folder).withColumn("shown", sizes.format_size_ui(F.col("size")))


@register(
    "format_time",
    """SELECT path, CASE WHEN accessed > 0
                    THEN strftime(make_timestamp(accessed * 1000000), '%Y-%m-%d %H:%M')
                    ELSE '' END AS shown
       FROM doc_entries""",
)
def format_time(spark, folder):
    docs = tables.doc_entries(spark, folder)
    return docs.select("path", dates.format_time(F.col("accessed")).alias("shown"))


_MARKED = "regexp_replace(name, '((?:ring|small)+)', '*\\1*', 'gi')"


@register("highlight", f"SELECT parent || '/' || {_MARKED} AS path FROM part_entries_p")
def highlight(spark, folder):
    parts = tables.part_entries(spark, folder)
    return parts.select(marks.mark_path(F.col("path"), ["Ring", "SMALL"]).alias("path"))


@register(
    "highlight_search",
    f"""SELECT parent || '/' || {_MARKED} AS path, name, size FROM part_entries_p
        WHERE contains(name_lc, 'ring') AND contains(name_lc, 'small')""",
)
def highlight_search(spark, folder):
    found = search(tables.part_entries(spark, folder), ["Ring", "SMALL"], highlight=True)
    return found.page.select("path", "name", "size")


@register(
    "render_ansi",
    f"""SELECT regexp_replace(parent || '/' || {_MARKED}, '\\*([^*]+)\\*',
               chr(27) || '[32m\\1' || chr(27) || '[0m', 'g') AS shown FROM part_entries_p""",
)
def render_ansi(spark, folder):
    marked = highlight(spark, folder)
    return marked.select(marks.render_ansi(F.col("path"), color=10).alias("shown"))


@register("strip_ansi", "SELECT path FROM part_entries")
def strip_ansi(spark, folder):
    shown = render_ansi(spark, folder)
    return shown.select(marks.strip_ansi(F.col("shown")).alias("path"))


_TYPES_SQL = " ".join(
    "WHEN extension IN ({}) THEN '{}'".format(", ".join(f"'{e}'" for e in extensions), name)
    for name, extensions in filetypes.FILE_TYPES.items()
)


@register(
    "file_type",
    f"SELECT path, CASE {_TYPES_SQL} ELSE '' END AS file_type FROM typed_entries_p",
)
def file_type(spark, folder):
    typed = with_parts(tables.typed_entries(spark, folder))
    return typed.select("path", filetypes.file_type(F.col("extension")).alias("file_type"))
