"""The same views as ``sources.tables``, written as SQL for the comparison."""

from pathlode.functions.filetypes import FILE_TYPES

_ALL_TYPES = [e for listed in FILE_TYPES.values() for e in listed] + ["log"]

_VIEWS = {
    "doc_entries": """
        SELECT '/data/' || source || '/' || lang || '/doc_' || doc_id ||
                 CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.mkv'
                                 WHEN 3 THEN '.MKV' WHEN 4 THEN '.tar.gz' ELSE '' END AS path,
               false AS is_dir, n_chars AS size,
               1704067200 + doc_id * 3600 AS modified,
               1704067200 + doc_id * 3600 - 86400 * (doc_id % 30) AS created,
               1704067200 + doc_id * 3600 + 60 * (doc_id % 1000) AS accessed
        FROM documents
        UNION ALL
        SELECT DISTINCT '/data/' || source || '/' || lang, true, 4096::BIGINT,
               0::BIGINT, 0::BIGINT, 0::BIGINT
        FROM documents""",
    "part_entries": """
        SELECT '/parts/' || p_brand || '/' || p_name || '_' || p_partkey || '.' || lower(p_type)
                 AS path,
               false AS is_dir, p_size::BIGINT * 1024 AS size,
               0::BIGINT AS modified, 0::BIGINT AS created, 0::BIGINT AS accessed
        FROM part""",
    "asked_entries": """
        SELECT '/asked/' || replace(p_name, ' ', '?') || '_' || p_partkey AS path,
               false AS is_dir, p_size::BIGINT AS size,
               0::BIGINT AS modified, 0::BIGINT AS created, 0::BIGINT AS accessed
        FROM part""",
    "page_entries": """
        SELECT '/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path,
               false AS is_dir, length(html)::BIGINT AS size,
               0::BIGINT AS modified, 0::BIGINT AS created, 0::BIGINT AS accessed
        FROM pages""",
    "line_rows": """
        SELECT '/orders/' || l_returnflag || l_linestatus || '/o_' || l_orderkey ||
                 '/line_' || l_linenumber ||
                 CASE l_returnflag WHEN 'A' THEN '.csv' WHEN 'N' THEN '.jpg' ELSE '.zip' END
                 AS path,
               false AS is_dir, floor(l_extendedprice)::BIGINT AS size,
               floor(epoch(l_shipdate))::BIGINT AS modified,
               0::BIGINT AS created, 0::BIGINT AS accessed,
               l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax
        FROM lineitem""",
    "line_entries": """
        SELECT path, is_dir, size, modified, created, accessed FROM line_rows""",
    "order_entries": """
        SELECT '/archive/c_' || o_custkey || '/file_' || lpad(o_orderkey::VARCHAR, 8, '0') ||
                 CASE o_orderstatus WHEN 'F' THEN '.txt' ELSE '.bin' END AS path,
               false AS is_dir, floor(o_totalprice)::BIGINT AS size,
               floor(epoch(o_orderdate))::BIGINT AS modified,
               0::BIGINT AS created, 0::BIGINT AS accessed
        FROM orders""",
    "typed_entries": f"""
        SELECT '/typed/' || o_custkey || '/f' || o_orderkey || '.' ||
                 CASE WHEN o_orderkey % 4 = 0 THEN upper(ext) ELSE ext END AS path,
               false AS is_dir, floor(o_totalprice)::BIGINT AS size,
               0::BIGINT AS modified, 0::BIGINT AS created, 0::BIGINT AS accessed
        FROM (SELECT *, ({_ALL_TYPES})[1 + o_orderkey % len({_ALL_TYPES})] AS ext FROM orders)""",
    "tree_places": """
        SELECT doc_id, n_chars,
               CASE doc_id % 9 WHEN 8 THEN '/proc/' || (doc_id % 5)
                               ELSE '/home/u' || (doc_id % 20) END ||
               CASE doc_id % 9 WHEN 0 THEN '/.cache/img' WHEN 1 THEN '/node_modules/pkg'
                               WHEN 2 THEN '/src/build.tmp' WHEN 3 THEN '/docs'
                               WHEN 4 THEN '/src.rs' WHEN 5 THEN '/src.rs/x.rs'
                               ELSE '/src' END AS place
        FROM documents""",
    "tree_entries": """
        SELECT place || '/' || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || 'doc_' || doc_id ||
                 CASE doc_id % 5 WHEN 0 THEN '.tmp' WHEN 1 THEN '.rs' WHEN 2 THEN '.txt'
                                 WHEN 3 THEN '.RS' ELSE '' END AS path,
               false AS is_dir, n_chars AS size,
               0::BIGINT AS modified, 0::BIGINT AS created, 0::BIGINT AS accessed
        FROM tree_places
        UNION ALL
        SELECT DISTINCT place, true, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
        FROM tree_places""",
    "user_entries": """
        SELECT '/u/' || (c_custkey % 60) || '/f_' || c_nationkey || '.log' AS path,
               false AS is_dir, max(abs(floor(c_acctbal)::BIGINT)) AS size,
               0::BIGINT AS modified, 0::BIGINT AS created, 0::BIGINT AS accessed
        FROM customer GROUP BY 1
        UNION ALL
        SELECT DISTINCT '/u/' || (c_custkey % 60), true, 4096::BIGINT,
               0::BIGINT, 0::BIGINT, 0::BIGINT
        FROM customer""",
    "event_numbers": """
        SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events""",
    "changes": """
        SELECT event_id AS seq, ts,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'create'
                               WHEN 'error' THEN 'delete' ELSE 'modify' END AS kind,
               '/u/' || (user_id % 50) ||
               CASE WHEN event_type = 'error' AND k % 10 = 0 THEN ''
                    ELSE '/f_' || (k % 20) || '.log' END AS path,
               NULL::VARCHAR AS to_path,
               false AS is_dir, floor(value)::BIGINT AS size, floor(epoch(ts))::BIGINT AS modified
        FROM event_numbers""",
    "feed": """
        SELECT event_id AS seq, ts,
               CASE WHEN event_type = 'view' AND value > 400 THEN 'overflow'
                    WHEN event_type = 'click' THEN 'move'
                    WHEN event_type IN ('signup', 'purchase') THEN 'create'
                    WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS kind,
               '/u/' || (user_id % 50) ||
               CASE WHEN event_type = 'error' AND k % 10 = 0 THEN ''
                    ELSE '/f_' || (k % 20) || '.log' END AS path,
               CASE WHEN event_type = 'click'
                    THEN '/u/' || ((user_id + 7) % 50) || '/moved_' || (k % 20) || '.log'
               END AS to_path,
               false AS is_dir, floor(value)::BIGINT AS size, floor(epoch(ts))::BIGINT AS modified
        FROM event_numbers""",
    "directory_feed": """
        SELECT seq, ts, kind,
               CASE WHEN kind = 'move' AND seq % 199 = 0 THEN '/u/' || (seq % 7) ELSE path END AS path,
               CASE WHEN kind = 'move' AND seq % 199 = 0
                    THEN '/u/' || (seq % 5) || CASE WHEN seq % 2 = 0 THEN '/in' ELSE '' END
                    ELSE to_path END AS to_path,
               kind = 'move' AND seq % 199 = 0 AS is_dir, size, modified
        FROM feed""",
}

_PARTS = """
    SELECT *, CASE WHEN is_dir OR strpos(name, '.') = 0 THEN ''
                   ELSE string_split(name, '.')[-1] END AS extension,
           CASE WHEN strpos(path, '/') = 0 THEN ''
                ELSE left(path, length(path) - length(name) - 1) END AS parent,
           lower(name) AS name_lc
    FROM (SELECT *, string_split(path, '/')[-1] AS name FROM {view})"""

# The same view with the derived columns, named <view>_p.
_WITH_PARTS = [v for v in _VIEWS if v.endswith("_entries")]


def with_views(body: str) -> str:
    """A query over the views as one statement."""
    ctes = {**_VIEWS, **{f"{v}_p": _PARTS.format(view=v) for v in _WITH_PARTS}}
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name in text and name not in needed:
                needed.add(name)
                todo.append(ctes[name])
    listed = ",\n".join(f"{name} AS ({ctes[name]})" for name in ctes if name in needed)
    body = body.strip()
    if not listed:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {listed},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {listed},\n{body[5:]}"
    return f"WITH {listed}\n{body}"
