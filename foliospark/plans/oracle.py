"""DuckDB SQL for the catalog's queries, put together from named steps."""

from __future__ import annotations

from html.entities import name2codepoint

ORACLES: dict[str, str] = {}

#: Steps by name: each may use those that its entry lists.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, needs: tuple[str, ...], sql: str) -> None:
    STEPS[name] = (needs, sql)


def _collect(names: tuple[str, ...], seen: list[str]) -> None:
    for n in names:
        if n not in seen:
            _collect(STEPS[n][0], seen)
            seen.append(n)


def oracle(name: str, needs: tuple[str, ...], sql: str) -> None:
    seen: list[str] = []
    _collect(needs, seen)
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS ({STEPS[n][1]})" for n in seen) + " " if seen else ""
    ORACLES[name] = head + sql


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1e-9, 6)"


def two(x: str) -> str:
    return f"printf('%.2f', CAST({x} AS DOUBLE) + 1e-9)"


#: White space as Python's str.split() has it.
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{WHITE}]"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{SPACE}+'), lambda w: w <> '')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def n_words(t: str) -> str:
    return f"CAST(len({words(t)}) AS INTEGER)"


def count(t: str, pattern: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{pattern}', '', 'g')))"


def found(t: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '{pattern}')) AS INTEGER)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


def repeats(cs: str) -> str:
    """Runs of three or more equal characters, of a list of characters."""
    return f"CAST(len(list_filter(range(1, len({cs}) - 1), lambda i: {cs}[i] = {cs}[i+1] AND {cs}[i] = {cs}[i+2] AND (i = 1 OR {cs}[i-1] <> {cs}[i]))) AS INTEGER)"


def singles(t: str) -> str:
    return f"CAST(len(list_filter({words(t)}, lambda w: length(w) = 1)) AS INTEGER)"


def longs(t: str) -> str:
    return f"CAST(len(list_filter({words(t)}, lambda w: length(w) > 20)) AS INTEGER)"


def clean(t: str) -> str:
    keep = r"""[^\p{L}\p{M}\p{N}_\s.,;:!?\-()\[\]"''/\\]"""
    return f"regexp_replace(regexp_replace({strip(t)}, '{SPACE}+', ' ', 'g'), '{keep}', '', 'g')"


def level(x: str) -> str:
    return f"CASE WHEN {x} >= 0.9 THEN 'excellent' WHEN {x} >= 0.8 THEN 'good' WHEN {x} >= 0.7 THEN 'acceptable' WHEN {x} >= 0.5 THEN 'poor' ELSE 'unusable' END"


PG = "doc_id, page_number"
BASE = "region_id, doc_id, page_number, line_no, n, conf_milli, confidence, x1, y1, x2, y2, text"

step("lines", (), "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents")
step("named", ("lines",), """
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE line_no % 12
        WHEN 0 THEN raw || ' \u2014' WHEN 8 THEN raw || ' \u2014'
        WHEN 3 THEN concat('- ', raw) WHEN 4 THEN concat('- ', raw) WHEN 5 THEN concat('2. ', raw) WHEN 7 THEN concat('Figure 1: ', raw) ELSE raw END AS text
    FROM lines WHERE trim(raw) <> ''""")
step("mixed", ("named",), """
    SELECT *, CAST(length(text) AS INTEGER) AS n, line_no % 12 AS r, CAST(1 + (line_no - line_no % 12) / 12 AS INTEGER) AS page_number,
        doc_id * 7919 + CAST(line_no AS BIGINT) * 104729 + length(text) * 31 AS h, 1 + doc_id % 2 AS nc FROM named""")
step("placed", ("mixed",), """
    SELECT *, CAST(CASE WHEN r = 8 AND nc = 1 THEN 140 WHEN r = 8 THEN 285 ELSE 50 + 300 * (r % nc) + 7 * (line_no % 3) END AS DOUBLE) AS x1,
        CAST(40 + 45 * ((r - r % nc) / nc) AS DOUBLE) AS y1 FROM mixed""")
step("regions", ("placed",), """
    SELECT concat(doc_id, '_', line_no) AS region_id, doc_id, page_number, line_no, n, CAST(300 + h % 700 AS INTEGER) AS conf_milli, CAST(300 + h % 700 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence,
        x1, y1, x1 + least(250, 20 + n) AS x2, y1 + 20 + 9 * (h % 6) AS y2, text FROM placed WHERE length(trim(text)) > 0""")
step("ordered", ("regions",), f"SELECT *, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY y1, x1, line_no) - 1 AS INTEGER) AS reading_order, max(x2) OVER (PARTITION BY {PG}) AS pw, max(y2) OVER (PARTITION BY {PG}) AS ph FROM regions")
step("typed", ("ordered",), r"""
    SELECT *, CASE WHEN y1 < ph * 0.2 AND length(trim(text)) < 100 AND NOT ends_with(trim(text), '.') THEN 'header' WHEN y1 > ph * 0.9 THEN 'footer'
        WHEN length(trim(text)) < 80 AND NOT ends_with(trim(text), '.') AND abs((x1 + x2) / 2 - pw / 2) < pw * 0.1 THEN 'title'
        WHEN regexp_matches(trim(text), '^[•·\-*○■]') OR (length(trim(text)) > 2 AND regexp_matches(trim(text), '^\p{Nd}[.):]')) THEN 'list'
        WHEN regexp_matches(lower(text), 'figure|table|chart|graph|image|fig\.|tab\.') THEN 'caption' ELSE 'paragraph' END AS region_type FROM ordered""")

oracle("regions_confident", ("regions",), "SELECT region_id, doc_id, page_number, confidence FROM regions WHERE confidence >= 0.6")
oracle("region_predicates", ("typed",), "SELECT doc_id, region_type, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.5) AS low, count(*) AS n FROM typed GROUP BY ALL")
oracle("regions_invalid", ("regions",), """
    , b AS (SELECT region_id, confidence + CASE WHEN line_no % 7 = 0 THEN 0.5 ELSE 0.0 END AS c, x2 - CASE WHEN line_no % 11 = 0 THEN 500.0 ELSE 0.0 END AS x, x1 FROM regions)
    SELECT region_id, concat_ws(',', CASE WHEN NOT c BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN NOT x > x1 THEN 'width' END) AS violations FROM b WHERE NOT c BETWEEN 0 AND 1 OR NOT x > x1""")
oracle("bbox_metrics", ("regions",), "SELECT region_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y FROM regions")
step("pairs", ("regions",), """
    SELECT a.doc_id, a.page_number, a.region_id AS region_a, b.region_id AS region_b, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS hh,
        least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS small
    FROM regions a JOIN regions b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.line_no < b.line_no AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1""")
oracle("overlap_pairs", ("pairs",), "SELECT doc_id, page_number, region_a, region_b, CASE WHEN w > 0 AND hh > 0 THEN w * hh END AS shared_area, w > 0 AND hh > 0 AND w * hh / small > 0.3 AS significant FROM pairs")
oracle("reading_order", ("ordered",), "SELECT region_id, doc_id, page_number, reading_order FROM ordered")
oracle("page_text", ("ordered",), f"SELECT {PG}, string_agg(text, ' ' ORDER BY reading_order) AS page_text FROM ordered GROUP BY ALL")
oracle("page_text_confident", ("ordered",), f"SELECT {PG}, string_agg(text, ' ' ORDER BY y1, x1, line_no) AS page_text FROM ordered WHERE confidence >= 0.8 GROUP BY ALL")
oracle("region_types_layout", ("typed",), "SELECT region_id, region_type FROM typed")
NUM = r"(length(text) > 2 AND regexp_matches(text, '^\p{Nd}[.):]'))"
LOW = "trim(lower(text))"
oracle("region_types_tesseract", ("regions",), rf"""
    SELECT region_id, CASE WHEN y1 < 135 AND length(text) < 100 THEN 'header' WHEN y1 > 765 THEN 'footer' WHEN length(text) < 80 AND y2 - y1 > 20 THEN 'title'
        WHEN regexp_matches({LOW}, '^[•·\-*]') OR {NUM} THEN 'list' WHEN regexp_matches({LOW}, '^(figure|table|chart|graph|image|fig\.|tab\.)') THEN 'caption' ELSE 'paragraph' END AS region_type FROM regions""")
oracle("region_types_fixed_px", ("regions",), rf"""
    SELECT region_id, CASE WHEN y1 * 2 < 100 AND length(text) < 100 THEN 'header' WHEN y1 * 2 > 800 THEN 'footer' WHEN length(text) < 60 AND NOT ends_with(text, '.') THEN 'title'
        WHEN regexp_matches({LOW}, '^[•·\-*○■□]') OR {NUM} THEN 'list' WHEN regexp_matches({LOW}, 'figure|table|chart|graph|image|fig\.|tab\.|caption') THEN 'caption' ELSE 'paragraph' END AS region_type FROM regions""")
oracle("region_types_relative", ("regions",), rf"""
    SELECT region_id, CASE WHEN y1 / 600 < 0.15 AND length(text) < 100 THEN 'header' WHEN y1 / 600 > 0.85 THEN 'footer' WHEN length(text) < 80 AND NOT ends_with(text, '.') THEN 'title'
        WHEN regexp_matches({LOW}, '^[•·\-*]') OR {NUM} THEN 'list' WHEN regexp_matches({LOW}, 'figure|table|chart|graph|image') THEN 'caption' ELSE 'paragraph' END AS region_type FROM regions""")
POLY = rf"""CASE WHEN y1 / 700 < 0.15 AND length(text) < 100 AND NOT ends_with(text, '.') THEN 'header'
        WHEN y1 / 700 > 0.85 OR regexp_matches({LOW}, 'page\s+\d+|copyright\s+©|©\s+\d{{4}}|confidential|proprietary|all rights reserved') THEN 'footer'
        WHEN CAST(length(text) < 80 AS INTEGER) + CAST(NOT ends_with(text, '.') AS INTEGER) + CAST((upper(text) = text AND lower(text) <> text)
            OR (array_to_string(list_transform(string_split(text, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') = text AND lower(text) <> upper(text)) AS INTEGER) + CAST((y2 - y1) / 700 > 0.02 AS INTEGER) >= 2 THEN 'title'
        WHEN regexp_matches({LOW}, '^([•·\-*○■□]\s+|\d+[.)]\s+|[a-z][.)]\s+|[ivxlcdm]+[.)]\s+)') THEN 'list'
        WHEN regexp_matches({LOW}, '^((figure|table|chart|graph|image|fig\.?|tab\.?|diagram)|(source|note):\s*|\([^)]*\)$)') THEN 'caption' ELSE 'paragraph' END"""
oracle("region_types_easyocr", ("regions",), f"SELECT region_id, {POLY} AS region_type FROM regions")
oracle("region_types_elements", ("regions",), "SELECT region_id, CASE line_no % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'header' WHEN 3 THEN 'list' WHEN 4 THEN 'table' WHEN 5 THEN 'footer' ELSE 'paragraph' END AS region_type FROM regions")
oracle("extraction_comparison", ("regions",), f"""
    , s AS (SELECT CASE WHEN regexp_matches(lower(text), '^[•\\-*]') THEN 'list' WHEN length(text) < 50 THEN 'title' ELSE 'paragraph' END AS simple, {POLY} AS improved, confidence FROM regions)
    SELECT 'simple' AS method, simple AS region_type, count(*) AS n, {r6('avg(confidence)')} AS mean_confidence FROM s GROUP BY ALL
    UNION ALL SELECT 'improved', improved, count(*), {r6('avg(confidence)')} FROM s GROUP BY ALL""")

for side, col in (("lefts", "x1"), ("rights", "x2")):
    step(f"{side}0", ("regions",), f"SELECT DISTINCT {PG}, {col} AS v FROM regions")
    step(f"{side}1", (f"{side}0",), f"SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY {PG} ORDER BY v) <= 30 THEN 0 ELSE 1 END AS b FROM {side}0")
    step(f"{side}2", (f"{side}1",), f"SELECT *, sum(b) OVER (PARTITION BY {PG} ORDER BY v) AS g FROM {side}1")
    step(side, (f"{side}2",), f"SELECT {PG}, min(v) AS edge FROM {side}2 GROUP BY {PG}, g")
step("bounds", ("lefts", "rights"), 'SELECT l.doc_id, l.page_number, l.edge AS "left", min(r.edge) AS "right" FROM lefts l JOIN rights r ON l.doc_id = r.doc_id AND l.page_number = r.page_number AND r.edge > l.edge GROUP BY ALL')
step("valid", ("bounds", "regions"), 'SELECT b.doc_id, b.page_number, b."left", b."right" FROM bounds b JOIN regions r ON b.doc_id = r.doc_id AND b.page_number = r.page_number AND (r.x1 + r.x2) / 2 BETWEEN b."left" AND b."right" WHERE b."right" - b."left" >= 100 GROUP BY ALL HAVING count(*) >= 2 AND sum(length(r.text)) >= 50')
step("cols0", ("valid", "regions"), f'SELECT * FROM valid UNION ALL SELECT {PG}, min(x1), max(x2) FROM regions r WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.doc_id = r.doc_id AND v.page_number = r.page_number) GROUP BY {PG}')
step("cols", ("cols0",), f'SELECT *, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY "left") - 1 AS INTEGER) AS column_index FROM cols0')
oracle("columns", ("cols",), f'SELECT {PG}, column_index, "left", "right" FROM cols')
oracle("column_gaps", ("cols",), f'SELECT * FROM (SELECT {PG}, column_index, lead("left") OVER (PARTITION BY {PG} ORDER BY "left") - "right" AS gap FROM cols) WHERE gap IS NOT NULL')
oracle("column_assignment", ("cols",), 'SELECT r.region_id, coalesce(min(c.column_index) FILTER ((r.x1 + r.x2) / 2 BETWEEN c."left" AND c."right"), 0) AS column_index FROM regions r JOIN cols c ON r.doc_id = c.doc_id AND r.page_number = c.page_number GROUP BY r.region_id')

step("co_i", ("regions",), f"SELECT *, (x1 + x2) / 2 AS cx, row_number() OVER (PARTITION BY {PG} ORDER BY line_no) AS i, count(*) OVER (PARTITION BY {PG}) AS cnt FROM regions")
step("co_r", ("co_i",), f"""
    SELECT {PG}, i, cnt, [cx] AS keys FROM co_i WHERE i = 1 UNION ALL
    SELECT b.doc_id, b.page_number, b.i, b.cnt, CASE WHEN len(list_filter(a.keys, lambda k: abs(b.cx - k) <= 50)) > 0 THEN a.keys ELSE list_append(a.keys, b.cx) END FROM co_r a JOIN co_i b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND b.i = a.i + 1""")
step("co_k", ("co_r", "co_i"), "SELECT c.*, list_filter(r.keys, lambda k: abs(c.cx - k) <= 50)[1] AS column_key FROM co_i c JOIN co_r r ON c.doc_id = r.doc_id AND c.page_number = r.page_number AND r.i = r.cnt")
step("co_m", ("co_k",), f"SELECT *, count(*) OVER (PARTITION BY {PG}, column_key) AS members FROM co_k")
step("co_n", ("co_m",), f"SELECT m.*, n.many FROM co_m m JOIN (SELECT {PG}, count(DISTINCT column_key) FILTER (members >= 2) > 1 AS many FROM co_m GROUP BY {PG}) n USING ({PG})")
oracle("column_reading_order", ("co_n",), f"SELECT {PG}, region_id, column_key, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY CASE WHEN many THEN column_key END, y1, CASE WHEN NOT many THEN x1 END, line_no) - 1 AS INTEGER) AS column_order FROM co_n WHERE NOT many OR members >= 2")

step("heads", ("typed",), f"SELECT {PG}, y1 AS head_y, arg_max(region_id, line_no) AS parent_region_id FROM typed WHERE region_type IN ('header', 'title') GROUP BY ALL")
step("spans", ("heads",), f"SELECT *, lead(head_y) OVER (PARTITION BY {PG} ORDER BY head_y) AS next_y FROM heads")
step("links", ("spans", "typed"), "SELECT t.doc_id, t.page_number, t.region_id, s.parent_region_id, s.head_y FROM typed t JOIN spans s ON t.doc_id = s.doc_id AND t.page_number = s.page_number AND t.y1 > s.head_y AND (s.next_y IS NULL OR t.y1 < s.next_y) WHERE t.region_type NOT IN ('header', 'title')")
oracle("hierarchy", ("links",), f"SELECT {PG}, region_id, parent_region_id FROM links")
step("kids", ("links", "typed"), "SELECT h.doc_id, h.page_number, h.region_id AS header_id, count(*) AS n_children FROM typed h JOIN links l ON h.doc_id = l.doc_id AND h.page_number = l.page_number AND h.y1 = l.head_y WHERE h.region_type IN ('header', 'title') GROUP BY ALL")
oracle("hierarchy_children", ("kids",), f"SELECT {PG}, header_id, n_children FROM kids")
oracle("layout_stats", ("typed", "cols", "kids", "links"), f"""
    , b AS (SELECT {PG}, count(*) AS total_regions, count(reading_order) AS o FROM typed GROUP BY ALL),
    ty AS (SELECT {PG}, region_type || ':' || count(*) AS s FROM typed GROUP BY {PG}, region_type),
    td AS (SELECT {PG}, string_agg(s, ',' ORDER BY s) AS type_distribution FROM ty GROUP BY ALL),
    c AS (SELECT {PG}, count(*) AS n FROM cols GROUP BY ALL), k AS (SELECT {PG}, count(*) AS n FROM kids GROUP BY ALL), p AS (SELECT {PG}, count(*) AS n FROM links GROUP BY ALL)
    SELECT b.doc_id, b.page_number, total_regions, type_distribution, coalesce(c.n, 0) AS columns_detected, coalesce(k.n, 0) AS with_children, coalesce(p.n, 0) AS with_parents, {r6('o / total_regions')} AS order_coverage
    FROM b JOIN td USING ({PG}) LEFT JOIN c USING ({PG}) LEFT JOIN k USING ({PG}) LEFT JOIN p USING ({PG})""")

OKEY = "CASE WHEN reading_order = 0 THEN CAST('inf' AS DOUBLE) ELSE reading_order END"
ORD = f"{OKEY}, y1, x1, line_no"
H = "((y2 - y1) + (p.y2 - p.y1))"
JOINED = {
    "paragraph": "y1 - lag(y2) OVER w < ((y2 - y1) + lag(y2 - y1) OVER w) / 2 * 0.5 OR least(x2, lag(x2) OVER w) - greatest(x1, lag(x1) OVER w) > least(x2 - x1, lag(x2 - x1) OVER w) * 0.7",
    "list": "y1 - lag(y2) OVER w < ((y2 - y1) + lag(y2 - y1) OVER w) / 2",
    "near": "sqrt(((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w) * ((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w) + ((y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w) * ((y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w)) < ((x2 - x1) + (y2 - y1) + lag((x2 - x1) + (y2 - y1)) OVER w) / 4 * 2.0",
    "confidence": "abs(y1 - lag(y1) OVER w) < ((y2 - y1) + lag(y2 - y1) OVER w) / 2 * 2.0 AND abs(x1 - lag(x1) OVER w) < ((x2 - x1) + lag(x2 - x1) OVER w) / 2 * 2.0 AND abs(confidence - lag(confidence) OVER w) <= 0.2",
    "row": "abs(y1 - lag(y1) OVER w) <= 20",
    "overlap": "least(x2, lag(x2) OVER w) - greatest(x1, lag(x1) OVER w) > 0 AND least(y2, lag(y2) OVER w) - greatest(y1, lag(y1) OVER w) > 0 AND (least(x2, lag(x2) OVER w) - greatest(x1, lag(x1) OVER w)) * (least(y2, lag(y2) OVER w) - greatest(y1, lag(y1) OVER w)) / least((x2 - x1) * (y2 - y1), lag((x2 - x1) * (y2 - y1)) OVER w) > 0.3",
}


def islands(name: str, source: str, rule: str, keys: str = PG, order: str = ORD, where: str = "true") -> None:
    step(f"{name}_b", (source,), f"SELECT *, CASE WHEN lag(1) OVER w IS NOT NULL AND ({JOINED[rule]}) THEN 0 ELSE 1 END AS brk FROM {source} WHERE {where} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})")
    step(name, (f"{name}_b",), f"SELECT *, CAST(sum(brk) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS group_no FROM {name}_b")


islands("g_paragraph", "typed", "paragraph", where="region_type = 'paragraph'")
islands("g_list", "typed", "list", where="region_type = 'list'")
islands("g_near", "typed", "near", order="y1, x1, line_no")
islands("g_conf", "typed", "confidence")
for q, g in (("paragraph_groups", "g_paragraph"), ("list_groups", "g_list"), ("proximity_groups", "g_near"), ("confidence_groups", "g_conf")):
    oracle(q, (g,), f"SELECT region_id, group_no FROM {g}")
oracle("confidence_categories", ("regions",), "SELECT region_id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS category FROM regions WHERE confidence >= 0.4")
islands("g_over", "typed", "overlap", order="y1, x1, line_no")
oracle("merged_regions", ("g_over",), f"""
    , m AS (SELECT {PG}, group_no, CAST(count(*) AS INTEGER) AS n_regions, string_agg(text, ' ' ORDER BY y1, x1, line_no) AS text, {r6('avg(confidence)')} AS confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, min(reading_order) AS reading_order FROM g_over GROUP BY ALL),
    t AS (SELECT {PG}, group_no, region_type, row_number() OVER (PARTITION BY {PG}, group_no ORDER BY count(*) DESC, region_type) AS k FROM g_over GROUP BY {PG}, group_no, region_type)
    SELECT m.*, t.region_type FROM m JOIN t USING ({PG}, group_no) WHERE k = 1""")
islands("g_row", "regions", "row", order="y1, line_no")
step("rows0", ("g_row",), f"SELECT *, count(*) OVER (PARTITION BY {PG}, group_no) AS row_size, count(*) OVER (PARTITION BY {PG}) AS on_page, CAST(row_number() OVER (PARTITION BY {PG}, group_no ORDER BY y1, line_no) - 1 AS INTEGER) AS cell_no FROM g_row")
step("rows1", ("rows0",), f"SELECT *, CAST(dense_rank() OVER (PARTITION BY {PG} ORDER BY group_no) - 1 AS INTEGER) AS row_no FROM rows0 WHERE row_size >= 2 AND on_page >= 4")
step("rows2", ("rows1",), f"SELECT * FROM (SELECT *, max(row_no) OVER (PARTITION BY {PG}) AS last_row FROM rows1) WHERE last_row >= 1")
oracle("table_rows", ("rows2",), "SELECT region_id, row_no, cell_no FROM rows2")
step("tab0", ("rows2",), f"SELECT r.* FROM rows2 r JOIN (SELECT {PG}, row_no FROM rows2 WHERE row_size >= 4 GROUP BY ALL HAVING count(DISTINCT round_even(x1, -1)) >= 2) k USING ({PG}, row_no)")
oracle("simple_tables", ("tab0",), f'SELECT {PG}, CAST(dense_rank() OVER (PARTITION BY {PG} ORDER BY row_no) - 1 AS INTEGER) AS table_idx, CAST(cell_no // 2 AS INTEGER) AS "row", cell_no % 2 AS col, text, confidence FROM tab0')

# Chunks: items in groups, packed by one recursive step for each item.
step("kept", ("typed",), f"SELECT *, CAST(length(trim(text)) AS BIGINT) AS ns, CAST(length(text) AS BIGINT) AS raw, CAST(row_number() OVER (PARTITION BY {PG}, region_type ORDER BY {ORD}) AS INTEGER) AS pos FROM typed WHERE confidence >= 0.6")
islands("k_par", "kept", "paragraph", order="pos", where="region_type = 'paragraph'")
islands("k_list", "kept", "list", order="pos", where="region_type = 'list'")
ITEM = f"region_id, {PG}, text, confidence, region_type, reading_order, x1, y1, x2, y2, ns, raw, pos"
step("opener", ("kept",), f"SELECT {ITEM.replace('pos', '0 AS pos')} FROM (SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY pos DESC) AS k FROM kept WHERE region_type = 'header' AND ns < 500) h WHERE k = 1 AND EXISTS (SELECT 1 FROM kept p WHERE p.doc_id = h.doc_id AND p.page_number = h.page_number AND p.region_type = 'paragraph')")
step("lay_items", ("k_par", "k_list", "opener"), f"SELECT 'paragraph' AS bucket, 3 AS bucket_rank, group_no, {ITEM} FROM k_par UNION ALL SELECT 'paragraph', 3, 0, {ITEM} FROM opener UNION ALL SELECT 'list', 4, group_no, {ITEM} FROM k_list")
step("ccat", ("typed",), "SELECT *, CAST(length(trim(text)) AS BIGINT) AS ns, CAST(length(text) AS BIGINT) AS raw, CASE WHEN confidence >= 0.8 THEN 'high' ELSE 'medium' END AS bucket FROM typed WHERE confidence >= 0.6")
step("ckept", ("ccat",), f"SELECT *, CAST(row_number() OVER (PARTITION BY {PG}, bucket ORDER BY {ORD}) AS INTEGER) AS pos FROM ccat")
islands("k_conf", "ckept", "confidence", keys=f"{PG}, bucket", order="pos")
step("conf_items", ("k_conf",), f"SELECT bucket, CASE bucket WHEN 'high' THEN 1 ELSE 2 END AS bucket_rank, group_no, {ITEM} FROM k_conf")
GRP = f"{PG}, bucket, group_no"


def packer(p: str, source: str, size: int, overlap: int, minimum: int) -> None:
    """Steps p_chunks: one row for each item of each chunk."""
    step(f"{p}_seq", (source,), f"SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {GRP}) AS cnt, coalesce(sum(raw) OVER (PARTITION BY {GRP} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(CASE bucket WHEN 'list' THEN raw ELSE ns END) OVER (PARTITION BY {GRP}) + count(*) OVER (PARTITION BY {GRP}) - 1 AS whole FROM {source} WINDOW w AS (PARTITION BY {GRP} ORDER BY pos)")
    on = "a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.bucket = b.bucket AND a.group_no = b.group_no"
    step(f"{p}_nb", (f"{p}_seq",), f"SELECT a.doc_id, a.page_number, a.bucket, a.group_no, a.bucket_rank, a.i, a.ns, a.raw, a.before, min(b.i) AS nb FROM {p}_seq a JOIN {p}_seq b ON {on} AND b.i <= a.i AND (a.before - b.before <= CASE a.bucket WHEN 'list' THEN 0 ELSE {overlap} END OR b.i = a.i) WHERE a.whole > {size} GROUP BY ALL")
    step(f"{p}_rec", (f"{p}_nb",), f"""
        SELECT {GRP}, i, CAST(0 AS BIGINT) AS s, CAST(ns AS BIGINT) AS len, 0 AS k FROM {p}_nb WHERE i = 0 UNION ALL
        SELECT b.doc_id, b.page_number, b.bucket, b.group_no, b.i, CASE WHEN a.len + b.ns > {size} THEN CASE b.bucket WHEN 'list' THEN b.i ELSE greatest(a.s, b.nb) END ELSE a.s END,
            CAST(CASE WHEN a.len + b.ns > {size} THEN CASE b.bucket WHEN 'list' THEN b.ns ELSE b.before + b.raw - (SELECT c.before FROM {p}_nb c WHERE c.doc_id = b.doc_id AND c.page_number = b.page_number AND c.bucket = b.bucket AND c.group_no = b.group_no AND c.i = greatest(a.s, b.nb)) END ELSE a.len + b.ns END AS BIGINT),
            a.k + CASE WHEN a.len + b.ns > {size} THEN 1 ELSE 0 END
        FROM {p}_rec a JOIN {p}_nb b ON {on} AND b.i = a.i + 1""")
    step(f"{p}_rng", (f"{p}_rec",), f"SELECT {GRP}, k AS chunk_no, min(s) AS s, max(i) AS e, max(k) OVER (PARTITION BY {GRP}) AS last FROM {p}_rec GROUP BY {GRP}, k")
    step(f"{p}_cut", (f"{p}_rng", f"{p}_seq"), f"SELECT r.chunk_no, CASE WHEN r.chunk_no = r.last THEN 'final' ELSE 'split' END AS kind, q.* FROM {p}_rng r JOIN {p}_seq q USING ({GRP}) WHERE q.i BETWEEN r.s AND r.e UNION ALL SELECT 0, 'whole', * FROM {p}_seq WHERE whole <= {size}")
    step(f"{p}_chunks", (f"{p}_cut",), f"SELECT * FROM (SELECT *, sum(ns) OVER (PARTITION BY {GRP}, chunk_no) + count(*) OVER (PARTITION BY {GRP}, chunk_no) - 1 AS made FROM {p}_cut) WHERE kind <> 'final' OR made >= {minimum}")


packer("lp", "lay_items", 600, 200, 100)
packer("cp", "conf_items", 600, 200, 100)
step("single", ("kept",), f"SELECT 0 AS chunk_no, 'whole' AS kind, region_type AS bucket, CASE region_type WHEN 'header' THEN 1 WHEN 'title' THEN 2 ELSE 5 END AS bucket_rank, pos AS group_no, {ITEM}, 0 AS i FROM kept WHERE region_type IN ('header', 'title', 'caption') AND ns >= 100")
step("foot", ("kept",), f"SELECT 0 AS chunk_no, 'whole' AS kind, 'footer' AS bucket, 7 AS bucket_rank, 0 AS group_no, {ITEM}, pos AS i FROM (SELECT *, sum(ns) OVER (PARTITION BY {PG}) + count(*) OVER (PARTITION BY {PG}) - 1 AS made FROM kept WHERE region_type = 'footer') WHERE made >= 100")
CI = f"chunk_no, kind, bucket, bucket_rank, group_no, {ITEM}, i"
step("lay_all", ("lp_chunks", "single", "foot"), f"SELECT {CI} FROM lp_chunks UNION ALL SELECT {CI} FROM single UNION ALL SELECT {CI} FROM foot")
step("conf_all", ("cp_chunks",), f"SELECT {CI} FROM cp_chunks")


def described(name: str, source: str, strategy: str, order: str) -> None:
    step(f"{name}_d", (source,), f"""
        SELECT {PG}, bucket, bucket_rank, group_no, chunk_no, string_agg(CASE WHEN bucket = 'list' AND kind = 'whole' THEN text ELSE trim(text) END, ' ' ORDER BY i) AS content, string_agg(text, ' ' ORDER BY i) AS joined,
            round(avg(confidence), 9) AS ac, var_pop(confidence) AS vc, min(confidence) AS min_confidence, max(confidence) AS max_confidence, array_to_string(list_sort(list_distinct(list(region_type))), ',') AS region_types, count(DISTINCT region_type) AS n_types,
            string_agg(region_id, ',' ORDER BY i) AS region_ids, min(CASE region_type WHEN 'title' THEN 0 WHEN 'header' THEN 1 WHEN 'list' THEN 3 WHEN 'caption' THEN 4 WHEN 'footer' THEN 5 ELSE 2 END) AS hierarchy_level,
            arg_min(reading_order, CASE WHEN reading_order = 0 THEN 1000000 ELSE reading_order END) AS reading_order, bool_or(region_type = 'header') AS is_header, bool_or(region_type = 'title') AS is_title, bool_or(region_type = 'footer') AS is_footer,
            min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_min(x1, i) AS fx, arg_min(y1, i) AS fy
        FROM {source} GROUP BY {PG}, bucket, bucket_rank, group_no, chunk_no""")
    step(f"{name}_i", (f"{name}_d",), f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, {OKEY}, {order}) - 1 AS INTEGER) AS chunk_index FROM {name}_d")
    step(f"{name}_k", (f"{name}_i",), f"""
        SELECT *, sha256(concat_ws('|', doc_id, page_number, '{strategy}', chunk_index)) AS chunk_id, CASE WHEN length(trim(content)) < 100 THEN 'Content too short' WHEN {ratio(singles('content'), f"len({words('content')})")} > 0.5 THEN 'Too many single-character artifacts'
            WHEN {ratio(count('content', '[\\p{L}\\p{N}]'), 'length(content)')} < 0.3 THEN 'Mostly non-alphanumeric content' END AS filter_reason FROM {name}_i""")
    step(name, (f"{name}_k",), f"SELECT *, filter_reason IS NOT NULL AS is_filtered, {n_words('joined')} AS word_count, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS previous_chunk_id FROM {name}_k")


described("lchunks", "lay_all", "layout_aware", "bucket_rank, group_no, chunk_no")
described("cchunks", "conf_all", "confidence_based", "fy, fx, bucket_rank, group_no, chunk_no")
SHOW = f"""SELECT chunk_id, {PG}, chunk_index, bucket, content, {r6('ac')} AS average_confidence, {r6('vc')} AS confidence_variance, min_confidence, max_confidence, word_count, CAST(length(joined) AS INTEGER) AS character_count, region_types, region_ids,
    hierarchy_level, reading_order, is_header, is_title, is_footer, false AS has_tables, x1, y1, x2, y2, is_filtered, filter_reason, (n_types > 3 OR min_confidence < 0.3) AS needs_review, previous_chunk_id FROM """
oracle("chunks_layout_aware", ("lchunks",), SHOW + "lchunks")
oracle("chunks_confidence", ("cchunks",), SHOW + "cchunks")
oracle("chunks_confidence_notes", ("cchunks",), f"SELECT chunk_id, 'Confidence category: ' || bucket || '; Confidence range: ' || {two('min_confidence')} || ' - ' || {two('max_confidence')} || '; Average confidence: ' || {two('ac')} || '; Confidence variance: ' || printf('%.3f', vc + 1e-9) AS processing_notes FROM cchunks")
oracle("chunk_stats", ("lchunks",), f"""SELECT count(*) AS total_chunks, count(*) FILTER (is_filtered) AS filtered_chunks, count(*) FILTER (ac >= 0.8) AS high_quality_chunks, count(*) FILTER (n_types > 3 OR min_confidence < 0.3) AS needs_review_chunks,
    {r6('avg(ac)')} AS average_confidence, {r6('min(ac)')} AS min_confidence, {r6('max(ac)')} AS max_confidence, {r6('avg(word_count)')} AS average_word_count, CAST(sum(word_count) AS BIGINT) AS total_words, min(word_count) AS min_words, max(word_count) AS max_words FROM lchunks""")
oracle("confidence_distribution", ("lchunks",), f"""
    , a AS (SELECT count(*) AS n, count(*) FILTER (ac >= 0.8) AS h, count(*) FILTER (ac >= 0.6 AND ac < 0.8) AS m, count(*) FILTER (ac >= 0.4 AND ac < 0.6) AS l, avg(ac) AS a, min(ac) AS lo, max(ac) AS hi, var_pop(ac) AS v FROM lchunks)
    SELECT n AS total_chunks, h AS high_confidence_chunks, m AS medium_confidence_chunks, l AS low_confidence_chunks, {r6('a')} AS average_confidence, {r6('lo')} AS min_confidence, {r6('hi')} AS max_confidence, {r6('v')} AS confidence_variance, {r6('h / n')} AS high_confidence_ratio, {r6('(h + m) / n')} AS reliable_chunks_ratio FROM a""")
oracle("rag_records", ("lchunks",), f"SELECT chunk_id AS id, {clean('content')} AS content, {PG}, chunk_index, {r6('ac')} AS confidence, word_count, region_types, false AS has_tables, is_header, hierarchy_level, 'layout_aware' AS chunking_strategy FROM lchunks")
RELIABLE = "ac >= 0.7 AND min_confidence >= 0.5 AND word_count >= 3"
READY = f"NOT is_filtered AND {RELIABLE} AND len({words(clean('content'))}) >= 3"
oracle("rag_ready", ("lchunks",), f"SELECT chunk_id, {PG}, {READY} AS rag_ready, ac >= 0.8 AND min_confidence >= 0.6 AS high_quality, {RELIABLE} AS reliable, ac >= 0.8 AS high_confidence, {r6('max_confidence - min_confidence')} AS confidence_range FROM lchunks WHERE ({READY}) OR ac >= 0.8")
oracle("context_summary", ("lchunks",), f"SELECT chunk_id, page_number AS page, word_count, {two('ac')} AS confidence, region_types, false AS has_tables, hierarchy_level, {RELIABLE} AS is_reliable FROM lchunks")
oracle("chunks_fixed", (), "WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS i FROM documents) SELECT doc_id, CAST(i // 400 AS INTEGER) AS chunk_index, substr(text, CAST(i AS INTEGER) + 1, 500) AS chunk FROM s")

# Tables
step("items", (), "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS k FROM lineitem")
step("cells", ("items",), """
    SELECT l_orderkey AS table_id, CAST(k AS INTEGER) AS "row", c.col, c.text, CAST(c.col * 100 AS DOUBLE) AS x1, CAST(k * 20 AS DOUBLE) AS y1, CAST(c.col * 100 + 90 AS DOUBLE) AS x2, CAST(k * 20 + 18 AS DOUBLE) AS y2
    FROM items, LATERAL (SELECT unnest([0, 1, 2, 3]) AS col, unnest([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR), l_returnflag]) AS text) c""")
step("cell1", ("cells",), 'SELECT table_id, "row", col, max(text) AS text FROM cells GROUP BY ALL')
step("dims", ("cells",), 'SELECT table_id, max("row") + 1 AS "rows", max(col) + 1 AS "columns", min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM cells GROUP BY ALL')
step("grid", ("dims", "cell1"), 'SELECT d.table_id, r.i AS "row", string_agg(coalesce(c.text, \'\'), \' | \' ORDER BY k.j) AS line FROM dims d, LATERAL (SELECT unnest(range(d."rows")) AS i) r, (SELECT unnest(range(4)) AS j) k LEFT JOIN cell1 c ON c.table_id = d.table_id AND c."row" = r.i AND c.col = k.j GROUP BY ALL')
step("gtext", ("grid", "dims"), 'SELECT d.*, string_agg(g.line, chr(10) ORDER BY g."row") AS table_text FROM dims d JOIN grid g USING (table_id) GROUP BY ALL')
oracle("table_text", ("gtext",), 'SELECT table_id, "rows", "columns", table_text, x1, y1, x2, y2 FROM gtext')
oracle("table_chunks", ("gtext",), f"SELECT sha256(concat_ws('|', table_id, 1, 'layout_aware', 0)) AS chunk_id, table_id AS doc_id, 1 AS page_number, table_text AS content, CAST(0.9 AS DOUBLE) AS average_confidence, 'table' AS region_types, true AS has_tables, {n_words('table_text')} AS word_count FROM gtext WHERE length({strip('table_text')}) >= 100")
oracle("table_cell_lookup", ("cells",), 'SELECT table_id, text FROM cells WHERE "row" = 0 AND col = 3')
oracle("table_from_blocks", ("cells",), 'SELECT table_id, "row", col, text, round(0.985, 6)::DOUBLE AS confidence, x1, y1, x2, y2 FROM cells')
oracle("block_words", ("cells",), "SELECT table_id, concat('w-', \"row\", '-', col) AS region_id, text, CAST(0.985 AS DOUBLE) AS confidence, x1, y1, CAST(row_number() OVER (PARTITION BY table_id ORDER BY y1, x1, concat('w-', \"row\", '-', col)) - 1 AS INTEGER) AS reading_order FROM cells")
step("inbox", ("regions",), f"SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY line_no) - 1 AS k FROM regions WHERE x1 >= 40 AND x2 <= 340 AND y1 >= 100 AND y2 <= 420")
oracle("table_contained_regions", ("inbox",), f'SELECT {PG}, 0 AS table_idx, region_id, CAST(k // 3 AS INTEGER) AS "row", CAST(k % 3 AS INTEGER) AS col FROM inbox')

# Tokens
step("tok0", (), "SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]'), lambda w: w <> '') AS ws FROM documents")
step("tok1", ("tok0",), "SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM tok0")
step("tok2", ("tok1",), "SELECT *, ['O', 'B-HEADER', 'I-HEADER', 'B-QUESTION', 'I-QUESTION', 'B-ANSWER', 'I-ANSWER', 'B-TABLE', 'I-TABLE', 'B-LIST', 'I-LIST', 'B-CAPTION', 'I-CAPTION'][CAST((pos - pos % 2 + doc_id) % 13 + 1 AS INTEGER)] AS l0 FROM tok1")
step("tok3", ("tok2",), "SELECT *, CASE WHEN pos % 2 = 1 AND l0 LIKE 'B-%' THEN 'I-' || substr(l0, 3) ELSE l0 END AS label, CAST(500 + (pos * 37 + doc_id * 11) % 500 AS DOUBLE) / 1000 AS confidence, CAST(pos % 10 * 60 AS DOUBLE) AS x1, CAST((pos - pos % 10) * 2 AS DOUBLE) AS y1 FROM tok2")
step("tok4", ("tok3",), "SELECT *, CASE WHEN label LIKE 'B-%' OR label = 'O' OR substr(label, 3) IS DISTINCT FROM lag(CASE WHEN label <> 'O' THEN substr(label, 3) END) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS b FROM tok3")
step("tok5", ("tok4",), "SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM tok4")
step("tok6", ("tok5",), "SELECT *, first_value(label) OVER (PARTITION BY doc_id, e ORDER BY pos) AS f FROM tok5")
oracle("bio_entities", ("tok6",), "SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS n_tokens, replace(string_agg(word, ' ' ORDER BY pos), ' ##', '') AS text, min(confidence) AS confidence, min(x1) AS x1, min(y1) AS y1, max(x1 + 50) AS x2, max(y1 + 15) AS y2, CASE WHEN substr(f, 3) IN ('HEADER', 'TABLE', 'LIST', 'CAPTION') THEN lower(substr(f, 3)) ELSE 'text' END AS region_type FROM tok6 WHERE f NOT LIKE 'I-%' GROUP BY doc_id, e, f")

# Quality
step("pm", ("regions",), f"SELECT {PG}, avg(confidence) AS oc, least(sum((x2 - x1) * (y2 - y1)) / 630000.0, 1.0) AS tc, count(*) FILTER (confidence < 0.5) AS low_confidence_regions, count(*) AS n_regions FROM regions GROUP BY ALL")
oracle("page_metrics", ("pm",), f"SELECT {PG}, {r6('oc')} AS overall_confidence, {r6('tc')} AS text_coverage_ratio, low_confidence_regions, n_regions, oc >= 0.8 AND tc >= 0.1 AND n_regions > 0 AS high_quality FROM pm")
step("cm0", ("regions",), f"SELECT {PG}, avg(confidence) AS mean, median(confidence) AS median, coalesce(stddev_samp(confidence), 0.0) AS sd, min(confidence) AS min_value, max(confidence) AS max_value, list_sort(list(confidence)) AS l, count(*) FILTER (confidence < 0.5) AS low_count, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium_count, count(*) FILTER (confidence >= 0.8) AS high_count FROM regions GROUP BY ALL")
step("cm", ("cm0",), "SELECT *, l[CAST(floor(len(l) * CAST(0.25 AS DOUBLE)) AS INTEGER) + 1] AS percentile_25, l[CAST(floor(len(l) * CAST(0.75 AS DOUBLE)) AS INTEGER) + 1] AS percentile_75, l[CAST(floor(len(l) * CAST(0.9 AS DOUBLE)) AS INTEGER) + 1] AS percentile_90, high_count / len(l) AS high_ratio FROM cm0")
oracle("confidence_metrics", ("cm",), f"SELECT {PG}, {r6('mean')} AS mean, {r6('median')} AS median, {r6('sd')} AS std_dev, min_value, max_value, low_count, medium_count, high_count, percentile_25, percentile_75, percentile_90, {level('mean')} AS quality_level, sd < 0.2 AS is_consistent, {r6('high_ratio')} AS high_ratio FROM cm")
step("ptext", ("typed",), f"SELECT {PG}, string_split(string_agg(text, ' ' ORDER BY y1, x1, line_no), '') AS cs, string_agg(text, ' ' ORDER BY y1, x1, line_no) AS t, count(*) FILTER (region_type = 'paragraph') AS paragraphs, count(*) FILTER (region_type IN ('header', 'title')) AS headers, count(*) FILTER (region_type = 'list') AS lists FROM typed GROUP BY ALL")
step("ct0", ("ptext",), f"""
    SELECT {PG}, paragraphs, headers, CAST(0 AS BIGINT) AS figures, lists, CAST(length(t) AS INTEGER) AS total_characters, {n_words('t')} AS total_words, {ratio(f"length(regexp_replace(t, '{SPACE}+', '', 'g'))", n_words('t'))} AS average_word_length, {found('t', '[.!?]+')} AS sentences,
        {ratio(count('t', '[^\\p{L}\\p{N}\\s]'), 'length(t)')} AS special_ratio, {ratio(count('t', '\\p{Nd}'), 'length(t)')} AS digit_ratio, {ratio(count('t', '\\p{Lu}'), 'length(t)')} AS uppercase_ratio, {repeats('cs')} AS repeated_sequences, {singles('t')} AS short_words, {longs('t')} AS long_words FROM ptext""")
step("ct1", ("ct0",), f"SELECT c.*, d.lang AS language, CAST(0 AS BIGINT) AS n_tables, CASE WHEN d.lang IS NOT NULL THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS language_confidence, {ratio('total_words', 'sentences')} AS words_per_sentence, {ratio('repeated_sequences + short_words', 'total_words')} AS artifact_ratio FROM ct0 c JOIN documents d USING (doc_id)")
step("ct", ("ct1",), "SELECT *, sentences > 0 AND words_per_sentence > 3 AND average_word_length > 2 AS has_structure FROM ct1")
_ROUND = ("average_word_length", "special_ratio", "digit_ratio", "uppercase_ratio", "words_per_sentence", "artifact_ratio")
oracle("content_metrics", ("ct",), "SELECT * REPLACE (" + ", ".join(f"{r6(c)} AS {c}" for c in _ROUND) + ") FROM ct")
step("crossed", ("pairs",), f"SELECT {PG}, count(*) AS \"overlaps\" FROM pairs GROUP BY ALL")
step("lm0", ("typed",), f"SELECT {PG}, count(*) AS total_regions, least(greatest(count(DISTINCT round_even(x1, -1)), 1), 5) AS columns_detected, count(DISTINCT region_type) AS hierarchy_levels, bool_or(region_type IN ('title', 'header')) AS titled, greatest(0.0, least(1.0, 1.0 - coalesce(var_samp(x1), 0.0) / 1000)) AS consistency FROM typed GROUP BY ALL")
step("lm", ("lm0", "crossed", "pm"), f"SELECT l.*, false AS order_detected, coalesce(c.\"overlaps\", 0) AS \"overlaps\", p.tc AS text_coverage_ratio, CAST(0 AS DOUBLE) AS order_confidence, CASE WHEN titled THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS title_confidence, p.tc > 0.1 AND consistency > 0.7 AND coalesce(c.\"overlaps\", 0) < total_regions * 0.1 AS good_layout FROM lm0 l LEFT JOIN crossed c USING ({PG}) JOIN pm p USING ({PG})")
oracle("layout_metrics", ("lm",), f"SELECT * EXCLUDE (titled) REPLACE ({r6('consistency')} AS consistency, {r6('text_coverage_ratio')} AS text_coverage_ratio) FROM lm")
step("q0", ("cm", "ct", "lm"), f"SELECT c.*, t.* EXCLUDE ({PG}), m.* EXCLUDE ({PG}) FROM cm c JOIN ct t USING ({PG}) JOIN lm m USING ({PG})")
step("q1", ("q0",), """
    SELECT *, least(greatest(mean * CAST(0.5 AS DOUBLE) + (CAST(0.5 AS DOUBLE) + CASE WHEN has_structure THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN artifact_ratio < 0.1 THEN CAST(0.2 AS DOUBLE) ELSE 0 END) * CAST(0.3 AS DOUBLE)
        + (CAST(0.5 AS DOUBLE) + CASE WHEN good_layout THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN text_coverage_ratio > 0.1 THEN CAST(0.2 AS DOUBLE) ELSE 0 END) * CAST(0.2 AS DOUBLE), 0.0), 1.0) AS score,
        list_filter([CASE WHEN mean < 0.6 THEN 'low_confidence' END, CASE WHEN artifact_ratio > 0.2 THEN 'garbled_text' END, CASE WHEN NOT has_structure THEN 'layout_errors' END, CASE WHEN language_confidence < 0.5 THEN 'language_detection_failed' END,
            CASE WHEN text_coverage_ratio < 0.05 THEN 'missing_text' END, CASE WHEN "overlaps" > total_regions * 0.2 THEN 'layout_errors' END], lambda i: i IS NOT NULL) AS issues,
        list_filter([CASE WHEN mean < 0.6 THEN 'reprocess with another engine or other settings' END, CASE WHEN sd > 0.3 THEN 'check the image: confidence varies' END, CASE WHEN artifact_ratio > 0.2 THEN 'preprocess the image to reduce noise' END,
            CASE WHEN NOT has_structure THEN 'use layout-aware settings' END, CASE WHEN language_confidence < 0.5 THEN 'name the language' END, CASE WHEN text_coverage_ratio < 0.05 THEN 'see whether the page is blank or an image' END,
            CASE WHEN "overlaps" > total_regions * 0.2 THEN 'use another segmentation mode' END], lambda i: i IS NOT NULL) AS advice FROM q0""")
step("q", ("q1",), "SELECT *, score >= 0.6 AND NOT list_has_any(issues, ['garbled_text', 'missing_text', 'poor_image_quality']) AS ok, score < 0.6 OR list_has_any(issues, ['low_confidence', 'garbled_text', 'missing_text', 'poor_image_quality']) OR high_ratio < 0.5 AS redo FROM q1")
oracle("page_quality", ("q",), f"SELECT {PG}, {r6('score')} AS overall_score, {level('score')} AS overall_level, array_to_string(issues, ',') AS issues, CAST(len(advice) AS INTEGER) AS n_recommendations, ok AS acceptable_for_rag, redo AS needs_reprocessing FROM q")
oracle("quality_issues", ("q",), f"""
    , e AS (SELECT *, unnest(list_distinct(issues)) AS issue FROM q)
    SELECT {PG}, issue, CASE WHEN issue = 'low_confidence' THEN 'mean confidence ' || {two('mean')} WHEN issue = 'garbled_text' THEN 'artifact ratio ' || {two('artifact_ratio')} WHEN issue = 'missing_text' THEN 'text coverage ' || {two('text_coverage_ratio')}
        WHEN issue = 'layout_errors' AND "overlaps" > total_regions * 0.2 THEN 'overlapping regions ' || "overlaps" ELSE replace(issue, '_', ' ') END AS description FROM e""")
oracle("document_quality", ("q",), f"""SELECT doc_id, {r6('avg(score)')} AS overall_quality_score, {r6('avg(mean)')} AS average_confidence, {r6('min(mean)')} AS min_page_confidence, {r6('max(mean)')} AS max_page_confidence, CAST(sum(total_characters) AS BIGINT) AS total_characters,
    CAST(0 AS BIGINT) AS tables_detected, CAST(0 AS BIGINT) AS figures_detected, max(language) AS languages, count(*) FILTER (ok) AS acceptable_pages, count(*) AS total_pages, string_agg(printf('%.3f', score + 1e-9), ',' ORDER BY page_number) AS page_scores FROM q GROUP BY doc_id""")
oracle("common_issues", ("q",), """
    , p AS (SELECT doc_id, count(*) AS pages FROM q GROUP BY 1), e AS (SELECT doc_id, unnest(issues) AS issue FROM q), k AS (SELECT doc_id, issue, count(*) AS occurrences FROM e GROUP BY ALL)
    SELECT doc_id, issue, occurrences, pages FROM k JOIN p USING (doc_id) WHERE occurrences > pages * 0.25""")
oracle("recommendations", ("q",), "SELECT DISTINCT doc_id, unnest(advice) AS recommendation FROM q")
_two = lambda x: f"round(CAST({x} AS DOUBLE) + 1e-9, 2)"
_flag = lambda x, yes, no: f"CASE WHEN {x} THEN '{yes}' ELSE '{no}' END"
oracle("quality_reports", ("q",), f"""SELECT {PG}, CAST(to_json({{
    'summary': {{'score': {_two('score')}, 'level': {level('score')}, 'confidence': {_two('mean')}, 'coverage': {_two('text_coverage_ratio')}, 'total_words': total_words, 'issues': len(issues)}},
    'confidence': {{'high_count': high_count, 'medium_count': medium_count, 'low_count': low_count, 'consistency': {_flag('sd < 0.2', 'consistent', 'variable')}}},
    'content': {{'structure': {_flag('has_structure', 'good', 'poor')}, 'language': language, 'figures': figures, 'headers': headers, 'tables': n_tables}},
    'layout': {{'quality': {_flag('good_layout', 'good', 'poor')}, 'columns_detected': columns_detected, 'reading_order': 'not_detected'}},
    'issues': issues, 'recommendations': list_sort(advice), 'verdict': {{'acceptable_for_rag': ok, 'needs_reprocessing': redo}}}}) AS VARCHAR) AS report FROM q""")
step("dp", ("q",), "SELECT doc_id, count(*) AS pages_processed, count(*) FILTER (NOT ok) AS pages_failed, avg(score) AS ps, sum(total_characters) AS chars, avg(mean) AS pc FROM q GROUP BY 1")
step("dc", ("lchunks",), f"SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (ac >= 0.8) AS high_quality_chunks, count(*) FILTER (is_filtered) AS filtered_chunks, count(*) FILTER ({READY}) AS rag_ready_chunks, avg(ac) AS cc, sum(length(content)) AS cchars FROM lchunks GROUP BY 1")
step("dr0", ("dp", "dc"), "SELECT p.*, coalesce(total_chunks, 0) AS total_chunks, coalesce(high_quality_chunks, 0) AS high_quality_chunks, coalesce(filtered_chunks, 0) AS filtered_chunks, coalesce(rag_ready_chunks, 0) AS rag_ready_chunks, coalesce(cc, pc) AS a, greatest(chars, coalesce(cchars, 0)) AS total_text, pages_processed / (pages_processed + pages_failed) AS sr, CASE WHEN coalesce(total_chunks, 0) > 0 THEN high_quality_chunks / total_chunks ELSE 0.0 END AS qr FROM dp p LEFT JOIN dc USING (doc_id)")
step("dr", ("dr0",), "SELECT *, CASE WHEN total_chunks > 0 THEN (a + sr + qr) / 3 ELSE ps END AS os FROM dr0")
oracle("document_result", ("dr",), f"SELECT doc_id, pages_processed, pages_failed, total_chunks, high_quality_chunks, filtered_chunks, rag_ready_chunks, {r6('sr')} AS success_rate, {r6('qr')} AS quality_rate, {r6('a')} AS average_confidence, {r6('os')} AS overall_score, CAST(total_text AS BIGINT) AS total_text, a >= 0.8 AND sr >= 0.9 AND qr >= 0.7 AS is_high_quality, 'completed' AS status, total_chunks > 0 AS is_successful, false AS has_errors FROM dr")
oracle("batch_summary", ("dr",), "SELECT count(*) AS documents, count(*) FILTER (total_chunks > 0) AS successful, count(*) FILTER (total_chunks = 0) AS failed FROM dr")
oracle("document_summary", ("dr",), f"SELECT doc_id, 'completed' AS status, pages_processed, total_chunks, rag_ready_chunks, {two('a')} AS average_confidence, {two('os')} AS overall_quality, {two('sr')} AS success_rate FROM dr")
oracle("document_text_confident", ("lchunks",), f"SELECT doc_id, string_agg({clean('content')}, ' ' ORDER BY chunk_index) AS document_text FROM lchunks WHERE ac >= 0.8 GROUP BY 1")

# Engines
step("ep", ("pm",), f"SELECT {PG}, tc, e.engine, e.priority, greatest(0.0, least(1.0, oc + ((doc_id * 31 + e.priority * 17) % 5 - 2) * CAST(0.06 AS DOUBLE))) AS oc FROM pm, (VALUES ('easyocr', 0), ('tesseract', 1), ('paddleocr', 2)) e(engine, priority)")
step("gt0", ("ep",), "SELECT doc_id, engine, priority, avg(oc) FILTER (oc > 0) AS av, avg(tc) FILTER (oc > 0) AS cv, avg(oc) AS al FROM ep GROUP BY ALL")
step("gt", ("gt0",), "SELECT *, coalesce(av >= CAST(0.6 AS DOUBLE) AND cv >= CAST(0.05 AS DOUBLE), false) AS passes FROM gt0")
oracle("engine_gate", ("gt",), f"SELECT doc_id, engine, {r6('av')} AS average, {r6('cv')} AS coverage, passes FROM gt")
oracle("engine_fallback", ("gt",), f"SELECT doc_id, engine, {r6('av')} AS average FROM gt WHERE passes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority) = 1")
oracle("engine_best", ("gt",), f"SELECT doc_id, engine, {r6('al')} AS average FROM gt WHERE passes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {r6('al')} DESC, priority) = 1")
oracle("engine_unresolved", ("gt",), "SELECT doc_id FROM gt GROUP BY 1 HAVING NOT bool_or(passes)")
oracle("longest_text", (), """
    WITH m AS (SELECT doc_id, 'base' AS model, 0 AS k, text FROM documents UNION ALL SELECT doc_id, 'large', 1, replace(text, '.', '') || CASE WHEN doc_id % 3 = 0 THEN repeat('x', 60) ELSE '' END FROM documents UNION ALL SELECT doc_id, 'layout', 2, replace(text, ',', ' ,') FROM documents)
    SELECT doc_id, model, text FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, k) = 1""")
step("wb", ("regions",), "SELECT *, CAST(conf_milli AS DOUBLE) / 10 - CASE WHEN line_no % 5 = 0 THEN 60 ELSE 0 END AS conf, y2 - y1 - CASE WHEN line_no % 8 = 0 THEN 100 ELSE 0 END AS hh FROM regions WHERE line_no % 9 <> 0")
oracle("engine_word_boxes", ("wb",), f"SELECT {PG}, line_no, {r6('conf / 100')} AS confidence, x1, y1, x1 + (x2 - x1) AS x2, y1 + hh AS y2, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY y1, x1, line_no) - 1 AS INTEGER) AS reading_order FROM wb WHERE conf >= 0 AND hh > 0")
oracle("engine_polygons", ("regions",), f"SELECT {PG}, line_no, least(x1 + 3, x2, x2 - 1, x1) AS x1, least(y1, y1 + 2, y2, y2 - 2) AS y1, greatest(x1 + 3, x2, x2 - 1, x1) AS x2, greatest(y1, y1 + 2, y2, y2 - 2) AS y2 FROM regions")

# Texts and files
step("spaced", ("regions",), "SELECT region_id, ' ' || chr(160) || replace(text, ' ', ' ' || chr(12288)) || chr(8232) || '#§ ' AS t FROM regions")
oracle("clean_text", ("spaced",), f"SELECT region_id, regexp_replace({strip('t')}, '{SPACE}+', ' ', 'g') AS clean_region, {clean('t')} AS clean_chunk FROM spaced")
SPACED = "replace(text, chr(10), ' ')"
for name, t in (("text_stats", "text"), ("text_stats_unicode", "replace(replace(replace(text, ', ', ',' || chr(160)), chr(10), chr(12288)), '. ', '.' || chr(8195))")):
    oracle(name, (), f"WITH a AS (SELECT doc_id, {t} AS text FROM documents), d AS (SELECT doc_id, text, string_split({SPACED}, '') AS cs FROM a) SELECT doc_id, {n_words('text')} AS words, {found('text', '[.!?]+')} AS sentences, CAST({count('text', '[^\\p{L}\\p{N}' + WHITE + ']')} AS INTEGER) AS special, CAST({count('text', '\\p{Nd}')} AS INTEGER) AS digits, CAST({count('text', '\\p{Lu}')} AS INTEGER) AS upper, {singles('text')} AS single, {longs('text')} AS long, {repeats('cs')} AS repeats FROM d")
oracle("readability", (), f"""
    WITH a AS (SELECT doc_id, text, CAST(nullif({n_words('text')}, 0) AS DOUBLE) AS w, CAST(greatest({found('text', '[.!?]+')}, 1) AS DOUBLE) AS s, CAST({count('text', '[\\p{L}\\p{N}]')} AS DOUBLE) AS c, CAST({found('lower(text)', '[aeiouy]+')} AS DOUBLE) AS y, CAST(len(list_filter({words('text')}, lambda x: len(regexp_extract_all(lower(x), '[aeiouy]+')) >= 3)) AS DOUBLE) AS h FROM documents)
    SELECT doc_id, {r6('CAST(4.71 AS DOUBLE) * c / w + CAST(0.5 AS DOUBLE) * w / s - CAST(21.43 AS DOUBLE)')} AS ari, {r6('CAST(0.0588 AS DOUBLE) * (100 * c / w) - CAST(0.296 AS DOUBLE) * (100 * s / w) - CAST(15.8 AS DOUBLE)')} AS coleman_liau,
        {r6('CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * w / s - CAST(84.6 AS DOUBLE) * y / w')} AS flesch, {r6('CAST(0.4 AS DOUBLE) * (w / s + 100 * h / w)')} AS fog, {r6('h / w')} AS difficult_ratio FROM a""")
step("paths", (), "SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', '') || ['.pdf', '.JPG', '.tif', '.png', '.html', ''][CAST(page_id % 6 + 1 AS INTEGER)], '(\\.[^./]+)$', 1)) AS ext FROM pages")
oracle("doc_types", ("paths",), """
    , k AS (SELECT page_id, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.jpg', '.jpeg', '.png', '.bmp') THEN 'image' WHEN ext IN ('.tiff', '.tif') THEN 'multi_page_tiff' ELSE 'unknown' END AS t FROM paths)
    SELECT page_id, t AS document_type, t IN ('image', 'multi_page_tiff') AS is_image, t IN ('pdf', 'scanned_pdf') AS is_pdf, t IN ('image', 'scanned_pdf', 'multi_page_tiff') AS requires_ocr FROM k""")
oracle("cache_keys", (), "SELECT page_id, md5(CASE WHEN page_id % 4 <> 0 THEN url || '_' || length(html) || '_1700000000' ELSE url END) AS cache_key FROM pages")
oracle("safe_dump", (), "SELECT page_id, '<' || octet_length(encode(html)) || ' bytes>' AS content FROM pages")
oracle("storage_embeddings", (), f"""
    SELECT vec_id, CAST(CASE WHEN len(embedding) <= 100 THEN len(embedding) END AS INTEGER) AS dims, {r6('list_sum(list_transform(embedding, lambda v, k: CAST(v AS DOUBLE) * k))')} AS weighed,
        CASE WHEN len(embedding) > 100 THEN '<' || len(embedding) || ' dimensions>' END AS small_note, CASE WHEN 2 * len(embedding) > 100 THEN '<' || 2 * len(embedding) || ' dimensions>' END AS large_note, 2 * len(embedding) > 100 AS large_gone FROM embeddings""")
oracle("json_encoding", (), """SELECT event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","content":"' || lower(hex(event_type)) || '","seconds":' || CAST(event_id % 1000 / CAST(4 AS DOUBLE) AS VARCHAR) || '}' AS json FROM events""")
step("pfiles", (), "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, CAST(length(html) AS VARCHAR) AS size FROM pages")
step("pmeta", ("pfiles",), "SELECT page_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS title, path AS source, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, md5(path || '_' || size || '_1700000000') AS cache_key FROM pfiles")
oracle("file_metadata", ("pmeta",), """
    , k AS (SELECT *, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.jpg', '.jpeg', '.png', '.bmp') THEN 'image' WHEN ext IN ('.tiff', '.tif') THEN 'multi_page_tiff' ELSE 'unknown' END AS t FROM pmeta)
    SELECT page_id, title, source, t AS document_type, t IN ('image', 'multi_page_tiff') AS is_image, t IN ('pdf', 'scanned_pdf') AS is_pdf, t IN ('image', 'scanned_pdf', 'multi_page_tiff') AS requires_ocr, cache_key FROM k""")
oracle("cached_files", (), "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL WHEN page_id % 2 = 0 THEN 'new' WHEN page_id % 4 * 10 + 1 < 24 THEN 'old' END AS result FROM pages")
_TAG = "h[1-6]|p|blockquote|pre|li|dt|dd|tr|caption|figcaption"
step("marked", (), rf"""SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(-->|$)', ' ', 'g'), '(?is)<script\b.*?(</script\s*>|$)', ' ', 'g'), '(?is)<style\b.*?(</style\s*>|$)', ' ', 'g'), '(?i)(</?({_TAG}|table)[\s/>])', chr(1) || '\1', 'g'), chr(1)) AS pieces FROM pages""")
step("begun", ("marked",), rf"SELECT page_id, list_filter(pieces, lambda x: regexp_matches(x, '(?i)^<({_TAG})[\s>]')) AS pieces FROM marked")
step("piece", ("begun",), "SELECT page_id, unnest(range(len(pieces))) AS pos, unnest(pieces) AS raw FROM begun")
_BARE = r"""regexp_replace(raw, '<([^>"'']|"[^"]*"|''[^'']*'')*(>|$)', ' ', 'g')"""
for _name, _code in sorted(name2codepoint.items()):
    if _code < 256 and _name != "amp" or _name in ("ndash", "mdash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo", "bull", "euro"):
        _BARE = f"replace({_BARE}, '&{_name};', chr({_code}))"
_BARE = f"replace(replace({_BARE}, '&#39;', chr(39)), '&amp;', '&')"
step("element", ("piece",), rf"""SELECT page_id, pos, lower(regexp_extract(raw, '^<([a-zA-Z0-9]+)', 1)) AS tag, regexp_replace({strip(_BARE)}, '{SPACE}+', ' ', 'g') AS text FROM piece""")
oracle("html_elements", ("element",), "SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN tag IN ('p', 'blockquote', 'pre') THEN 'paragraph' WHEN tag IN ('li', 'dt', 'dd') THEN 'list' WHEN tag = 'tr' THEN 'table' WHEN tag IN ('caption', 'figcaption') THEN 'caption' ELSE 'title' END AS type, text FROM element WHERE text <> ''")
oracle("engine_presets", (), """
    WITH k AS (SELECT * FROM (VALUES ('general'), ('forms'), ('tables'), ('handwritten')) a(document_type), (VALUES ('speed', ['easyocr', 'tesseract']), ('balanced', ['easyocr', 'tesseract', 'aws_textract']), ('quality', ['aws_textract', 'easyocr', 'tesseract'])) b(priority, plan), (VALUES (false), (true)) c(cloud)),
    o AS (SELECT *, CASE WHEN document_type IN ('forms', 'tables') AND priority <> 'speed' THEN ['aws_textract', 'easyocr', 'tesseract'] WHEN document_type = 'handwritten' THEN list_append(list_filter(plan, lambda e: e <> 'tesseract'), 'tesseract') ELSE plan END AS chosen FROM k)
    SELECT document_type, priority, cloud, array_to_string(list_filter(chosen, lambda e: cloud OR e <> 'aws_textract'), ',') AS engines, priority = 'quality' AS parallel FROM o""")
oracle("supported_formats", (), "SELECT unnest(['pdf', 'png', 'jpg', 'jpeg', 'tiff', 'bmp']) AS format")

# Pages, engines, languages. None of these libraries is at hand where the queries are checked.
oracle("engine_status", (), "SELECT * FROM (VALUES ('aws_textract', false), ('easyocr', false), ('layoutlmv3', false), ('paddleocr', false), ('precomputed', true), ('tesseract', false), ('trocr', false)) v(engine, available)")
oracle("optional_libraries", (), "SELECT * FROM (VALUES ('layoutparser', false), ('shapely', false), ('unstructured', false)) v(library, available)")
step("pix0", (), "SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) % 256) AS g FROM embeddings WHERE vec_id % 10 <> 9")
step("pix", ("pix0",), "SELECT vec_id, p.n AS page_number, list_transform(g, lambda v: CASE WHEN p.n = 2 THEN 255 - v ELSE v END) AS g FROM pix0, (VALUES (1), (2)) p(n) WHERE vec_id % 10 <> 7 AND (p.n = 1 OR vec_id % 3 = 2)")
oracle("page_images", ("pix",), """
    SELECT '/scans/' || vec_id AS path, page_number, 8 AS height, 8 AS width, CASE WHEN vec_id % 3 = 1 THEN 3 ELSE 1 END AS channels,
        CAST(list_sum(list_transform(g, lambda v, k: CASE WHEN vec_id % 3 = 1 THEN v * (9 * k - 3) ELSE v * k END)) AS BIGINT) AS weighed, false AS failed FROM pix
    UNION ALL SELECT '/scans/' || vec_id, 0, 0, 0, 0, 0, true FROM pix0 WHERE vec_id % 10 = 7""")
oracle("bio_tables", ("tok6",), "SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS n_tokens, replace(string_agg(word, ' ' ORDER BY pos), ' ##', '') AS text FROM tok6 WHERE f NOT LIKE 'I-%' AND substr(f, 3) = 'TABLE' GROUP BY doc_id, e, f")
_STOP = {
    "de": "der die das und ist nicht ein eine von mit den dem zu im auf sich des für auch als an es werden aus", "en": "the and of to in is that it was for on with as are be this have from or by not but they you which",
    "es": "el los las y que una un por con para del se al como es su más pero sus lo está entre cuando muy", "fr": "le la les et des est une un que dans pour pas sur au par plus du qui ce il avec sont aux ne",
}
step("lang0", ("ordered",), f"SELECT {PG}, string_agg(text, ' ' ORDER BY reading_order) AS t FROM ordered GROUP BY ALL")
_HEARD = words("regexp_replace(lower(t), '[.,;:!?()" + '"' + "]+', ' ', 'g')")
step("lang1", ("lang0",), f"SELECT *, {_HEARD} AS ws FROM lang0")
step("lang2", ("lang1",), "SELECT *, " + ", ".join(f"len(list_filter(ws, lambda w: list_contains({v.split()!r}, w))) AS {k}" for k, v in _STOP.items()) + " FROM lang1")
oracle("page_language", ("lang2",), f"SELECT {PG}, CASE WHEN length({strip('t')}) <= 20 OR greatest(de, en, es, fr) = 0 THEN 'en' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS language FROM lang2")
oracle("model_confidence", (), f"""
    WITH m AS (SELECT doc_id, CAST(c AS DOUBLE) - CAST(doc_id % 10 AS DOUBLE) / 100 AS confidence FROM documents, (VALUES (0, 0.9), (1, 0.95), (2, 0.85)) v(k, c) WHERE (doc_id + k) % 4 <> 0)
    SELECT doc_id, count(*) AS models, {r6('avg(confidence)')} AS mean_confidence FROM m GROUP BY 1""")
step("seen", ("regions",), f"SELECT {PG}, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY line_no) - 1 AS INTEGER) AS line_no, text, confidence, (x2 - x1) * (y2 - y1) AS area, (doc_id + page_number) % 7 = 0 AS failed FROM regions")
oracle("engine_recognize", ("seen",), f"SELECT {PG}, line_no, text, confidence, false AS failed FROM seen WHERE NOT failed UNION ALL SELECT DISTINCT {PG}, -1, 'TypeError: ''NoneType'' object is not iterable', CAST(0 AS DOUBLE), true FROM seen WHERE failed")
step("turn0", ("seen",), f"SELECT e.engine, e.priority, {PG}, CASE WHEN bool_or(failed) THEN 0 ELSE avg(confidence * CASE WHEN e.engine = 'dim' AND doc_id % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE 1 END) END AS oc, CASE WHEN bool_or(failed) THEN 0 ELSE least(sum(area) / 630000.0, 1.0) END AS tc, CASE WHEN bool_or(failed) THEN 0 ELSE count(*) END AS n FROM seen, (VALUES ('dim', 0), ('plain', 1)) e(engine, priority) GROUP BY ALL")
step("turn", ("turn0",), "SELECT doc_id, engine, priority, sum(n) AS n, coalesce(avg(oc) FILTER (oc > 0) >= CAST(0.6 AS DOUBLE) AND avg(tc) FILTER (oc > 0) >= CAST(0.05 AS DOUBLE), false) AS passes FROM turn0 GROUP BY ALL")
oracle("engines_in_turn", ("turn",), "SELECT doc_id, arg_min(engine, priority) FILTER (passes) AS engine, CAST(coalesce(arg_min(n, priority) FILTER (passes), 0) AS BIGINT) AS n_regions FROM turn GROUP BY 1")
oracle("broken_paragraphs", (), f"""
    WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS para FROM documents),
    l AS (SELECT doc_id, i, unnest(range(len(string_split(para, ', ')))) AS j, len(string_split(para, ', ')) AS m, regexp_matches(para, '^\\s*[•·▪●○■□*\\-–]') AS bullet, unnest(string_split(para, ', ')) AS line FROM p),
    c AS (SELECT *, regexp_replace(line, '^ +| +$', '', 'g') || CASE WHEN j < m - 1 THEN ',' ELSE '' END AS whole FROM l),
    g AS (SELECT doc_id, i, CASE WHEN any_value(bullet) OR max({n_words('whole')}) < 5 THEN string_agg(whole, chr(10) || chr(10) ORDER BY j) ELSE string_agg(whole, ' ' ORDER BY j) END AS t FROM c GROUP BY ALL)
    SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM g WHERE {strip('t')} <> '' GROUP BY 1""")


# A query that starts with a comma goes on with the steps' WITH.
ORACLES = {k: v.replace(") \n    , ", "), ").replace(")  , ", "), ") for k, v in ORACLES.items()}
