"""Independent DuckDB SQL for every registered query.

The SQL is generated from the lake's table list and Parquet schemas (read
with pyarrow, metadata only) and runs against views named after the tables.
It is deliberately a different formulation from the Spark plans:

* the column-pair matrices are built with plain cross products;
* texts are materialised with ``string_agg`` and tokenised whole (the Spark
  side sums token bags of the parts);
* optimal alignments are a dynamic program over bitmasks of used columns
  in a recursive CTE (exponential in the narrower table's partner width -
  test-size only);
* first-appearance order comes from ``row_number() OVER ()`` over the view,
  which follows file order for these single-row-group files.
"""

from __future__ import annotations

import posixpath

from lakesift.config import (CLEAN_DIGITS, CARDINALITY_WEIGHT, EMBEDDING_DIM, JACCARD_WEIGHT, NORM_EPSILON,
                             NUMERIC_CARDINALITY_CUTOFF, OUTPUT_DIGITS, SAMPLE_VALUES,
                             SEMANTIC_GATE, SEMANTIC_THRESHOLD, TABLE_TEXT_COLUMNS, TOP_K,
                             JOIN_THRESHOLD, UNION_THRESHOLD)
from lakesift.functions.text import NUMERIC_PATTERN, STRIP_PATTERN, TOKEN_SPLIT_PATTERN

SCHEMA_DIR = "/root/testdata/sf0.001"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cell(col: str, kind: str) -> str:
    """Cell text; a floating NaN counts as missing."""
    if kind == "float":
        return f"CASE WHEN isnan(\"{col}\") THEN NULL ELSE CAST(\"{col}\" AS VARCHAR) END"
    return f"CAST(\"{col}\" AS VARCHAR)"


def _src_class(arrow_type) -> str:
    import pyarrow as pa

    t = arrow_type
    if pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_decimal(t) or pa.types.is_boolean(t):
        return "numeric"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "text"
    return "other"


def _is_float(arrow_type) -> bool:
    import pyarrow as pa

    return pa.types.is_floating(arrow_type)


def lake_spec(tables: tuple[str, ...], schema_dir: str = SCHEMA_DIR) -> list[tuple[str, str, list[tuple[str, str]]]]:
    """[(view, file name, [(column, src_class)])] in path order."""
    import pyarrow.parquet as pq

    out = []
    for view in sorted(tables, key=lambda t: f"{t}.parquet"):
        schema = pq.read_schema(posixpath.join(schema_dir, f"{view}.parquet"))
        out.append((view, f"{view}.parquet",
                    [(f.name, "float" if _is_float(f.type) else _src_class(f.type)) for f in schema]))
    return out


class Oracle:
    def __init__(self, spec):
        self.spec = spec

    # -- building blocks (CTE bodies) ------------------------------------------------
    def ctes(self) -> dict[str, str]:
        spec = self.spec
        cells = []
        for ti, (view, _, cols) in enumerate(spec):
            items = ", ".join(
                f"struct_pack(col_idx := {ci}, value := {_cell(c, k)})" for ci, (c, k) in enumerate(cols))
            cells.append(f"SELECT {ti} AS table_idx, ord, unnest([{items}]) AS s "
                         f"FROM (SELECT row_number() OVER () AS ord, * FROM {view})")
        tabs = ", ".join(f"({ti}, {_lit(name)}, {len(cols)})" for ti, (_, name, cols) in enumerate(spec))
        coldim = ", ".join(f"({ti}, {ci}, {_lit(c)}, {_lit('numeric' if k == 'float' else k)})"
                           for ti, (_, _, cols) in enumerate(spec) for ci, (c, k) in enumerate(cols))
        num, strip, split = _lit(NUMERIC_PATTERN), _lit(STRIP_PATTERN), _lit(TOKEN_SPLIT_PATTERN)
        dim = EMBEDDING_DIM
        return {
            "tabs": f"SELECT * FROM (VALUES {tabs}) AS t(table_idx, table_name, n_cols)",
            "coldim": f"SELECT * FROM (VALUES {coldim}) AS t(table_idx, col_idx, column_name, src_class)",
            "cells0": " UNION ALL ".join(cells),
            "cells": "SELECT table_idx, s.col_idx AS col_idx, s.value AS value, ord FROM cells0",
            "raw": "SELECT table_idx, col_idx, value, count(*) AS n, min(ord) AS first FROM cells GROUP BY ALL",
            "stats": f"""SELECT r.table_idx, r.col_idx, sum(n) AS n_rows,
                    coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS nn,
                    count(value) AS n_distinct,
                    bool_and(regexp_matches(value, {num})) FILTER (WHERE value IS NOT NULL) AS all_num
                 FROM raw r GROUP BY ALL""",
            "norm": f"""SELECT table_idx, col_idx, regexp_replace(lower(value), {strip}, '', 'g') AS value,
                    sum(n) AS freq, min(first) AS first FROM raw WHERE value IS NOT NULL GROUP BY ALL""",
            "topv": f"""SELECT *, row_number() OVER (PARTITION BY table_idx, col_idx
                                               ORDER BY freq DESC, first ASC, value ASC) AS rank
                 FROM norm QUALIFY rank <= {TOP_K}""",
            "setsize": "SELECT table_idx, col_idx, count(*) AS n_values FROM topv GROUP BY ALL",
            "prof": """SELECT d.table_idx, d.col_idx, d.column_name, d.src_class,
                    CASE WHEN coalesce(s.nn, 0) > 0 AND (d.src_class = 'numeric'
                         OR (d.src_class = 'text' AND coalesce(s.all_num, false))) THEN 'numeric' ELSE 'string' END AS inferred_type,
                    coalesce(s.n_rows, 0) AS n_rows, coalesce(s.nn, 0) AS n_non_null,
                    coalesce(s.n_distinct, 0) AS n_distinct,
                    CASE WHEN coalesce(s.nn, 0) > 0 THEN s.n_distinct / s.nn ELSE 0.0 END AS cardinality_ratio,
                    CASE WHEN coalesce(s.nn, 0) > 0 THEN (s.n_rows - s.nn) / s.n_rows ELSE 1.0 END AS null_ratio,
                    coalesce(z.n_values, 0) AS n_values
                 FROM coldim d LEFT JOIN stats s USING (table_idx, col_idx)
                 LEFT JOIN setsize z USING (table_idx, col_idx)""",
            "vals": """SELECT t.table_idx, t.col_idx, p.inferred_type, t.value
                 FROM topv t JOIN prof p USING (table_idx, col_idx)""",
            "pairs": "SELECT a.table_idx AS q_idx, b.table_idx AS c_idx FROM tabs a CROSS JOIN tabs b",
            "ov": """SELECT a.table_idx AS q_idx, b.table_idx AS c_idx, a.col_idx AS q_col, b.col_idx AS c_col,
                    count(*) AS k
                 FROM vals a JOIN vals b ON a.inferred_type = b.inferred_type AND a.value = b.value
                 GROUP BY ALL""",
            "elig": f"""SELECT table_idx, col_idx, n_values FROM prof
                 WHERE NOT (inferred_type = 'numeric' AND cardinality_ratio > {NUMERIC_CARDINALITY_CUTOFF})
                   AND n_values > 0""",
            "cont": """SELECT o.q_idx, o.c_idx, o.q_col, o.c_col, o.k,
                    o.k / q.n_values AS containment_q, o.k / c.n_values AS containment_c
                 FROM ov o JOIN elig q ON q.table_idx = o.q_idx AND q.col_idx = o.q_col
                 JOIN elig c ON c.table_idx = o.c_idx AND c.col_idx = o.c_col""",
            "joinability": """SELECT p.q_idx, p.c_idx,
                    coalesce(max(greatest(t.containment_q, t.containment_c)), 0.0) AS joinability
                 FROM pairs p LEFT JOIN cont t USING (q_idx, c_idx) GROUP BY ALL""",
            "cm": """SELECT p.q_idx, p.c_idx, a.col_idx AS q_col, b.col_idx AS c_col,
                    a.inferred_type AS type_q, b.inferred_type AS type_c,
                    a.cardinality_ratio AS card_q, b.cardinality_ratio AS card_c,
                    a.n_values AS size_q, b.n_values AS size_c, coalesce(o.k, 0) AS k
                 FROM pairs p JOIN prof a ON a.table_idx = p.q_idx JOIN prof b ON b.table_idx = p.c_idx
                 LEFT JOIN ov o ON o.q_idx = p.q_idx AND o.c_idx = p.c_idx AND o.q_col = a.col_idx AND o.c_col = b.col_idx""",
            "jac": """SELECT *, CASE WHEN size_q = 0 AND size_c = 0 THEN 1.0
                                  WHEN size_q = 0 OR size_c = 0 THEN 0.0
                                  ELSE k / (size_q + size_c - k) END AS jaccard FROM cm""",
            "um": f"""SELECT q_idx, c_idx, q_col, c_col,
                    CASE WHEN type_q <> type_c THEN 0.0
                         ELSE {JACCARD_WEIGHT} * jaccard + {CARDINALITY_WEIGHT} * (1.0 - abs(card_q - card_c)) END AS s
                 FROM jac""",
            "dims": """SELECT p.q_idx, p.c_idx, a.n_cols AS n_q, b.n_cols AS n_c,
                    least(a.n_cols, b.n_cols) AS lo, greatest(a.n_cols, b.n_cols) AS hi
                 FROM pairs p JOIN tabs a ON a.table_idx = p.q_idx JOIN tabs b ON b.table_idx = p.c_idx""",
            # -- alignment: DP over (row, mask of used columns) ------------------
            "um_o": _orient("um"),
            "dpu": _dp("dpu", "um_o", "dims"),
            "union_total": _dp_total("dpu", "dims"),
            "unionability": """SELECT d.q_idx, d.c_idx,
                    CASE WHEN d.lo = 0 THEN 0.0 ELSE (u.total / d.lo) * (d.lo / d.hi) END AS unionability
                 FROM dims d LEFT JOIN union_total u USING (q_idx, c_idx)""",
            # -- semantic -------------------------------------------------------------
            "firsts": """SELECT table_idx, col_idx, lower(value) AS value, min(first) AS first
                 FROM raw WHERE value IS NOT NULL GROUP BY ALL""",
            "samp": f"""SELECT *, row_number() OVER (PARTITION BY table_idx, col_idx ORDER BY first) AS pos
                 FROM firsts QUALIFY pos <= {SAMPLE_VALUES}""",
            # -- token co-occurrences: within four tokens, or under a column name ------
            "toks": f"""SELECT table_idx, col_idx, list_filter(string_split_regex(lower(value), {split}), lambda t: t <> '') AS t FROM samp""",
            "near": """SELECT p.x AS x, p.y AS y FROM (
                   SELECT unnest([struct_pack(x := t[i], y := t[i + d]) for i in range(1, len(t) - d + 1)]) AS p
                   FROM toks, (VALUES (1), (2), (3), (4)) AS v(d))""",
            "nametoks": f"""SELECT DISTINCT table_idx, col_idx, tok AS y FROM (
                   SELECT table_idx, col_idx, unnest(string_split_regex(lower(column_name), {split})) AS tok FROM prof) WHERE tok <> ''""",
            "valuetoks": "SELECT table_idx, col_idx, unnest(t) AS x FROM toks",
            "met": """SELECT x, y FROM near WHERE x <> y UNION ALL
                   SELECT x, y FROM valuetoks JOIN nametoks USING (table_idx, col_idx) WHERE x <> y""",
            "cooc": """SELECT x, y, count(*) AS n FROM (SELECT x, y FROM met UNION ALL SELECT y, x FROM met) GROUP BY ALL""",
            "often": "SELECT x AS tok FROM cooc GROUP BY x HAVING sum(n) >= 20",
            "kept": "SELECT x, y, n FROM cooc WHERE x IN (SELECT tok FROM often) AND y IN (SELECT tok FROM often)",
            "marginal": "SELECT x AS tok, sum(n) AS s FROM kept GROUP BY x",
            "weighed": """SELECT k.x, k.y, k.n, a.s AS nx, b.s AS ny, (SELECT sum(s) FROM marginal) AS total
                 FROM kept k JOIN marginal a ON a.tok = k.x JOIN marginal b ON b.tok = k.y""",
            "joined": """SELECT table_idx, col_idx, string_agg(value, ', ' ORDER BY pos) AS vals
                 FROM samp GROUP BY ALL""",
            "coltext": """SELECT p.table_idx, p.col_idx,
                    CASE WHEN p.n_non_null = 0 THEN 'Column: ' || p.column_name || ' | Type: empty'
                         ELSE 'Column: ' || p.column_name || ' | Type: ' || p.inferred_type || ' | Values: '
                              || coalesce(j.vals, '') END AS column_text
                 FROM prof p LEFT JOIN joined j USING (table_idx, col_idx)""",
            "tabparts": f"""SELECT p.table_idx,
                    string_agg(p.column_name || '(' || p.inferred_type || '): ' || coalesce(j.vals, ''), ' | '
                               ORDER BY p.col_idx) AS parts
                 FROM prof p LEFT JOIN joined j USING (table_idx, col_idx)
                 WHERE p.col_idx < {TABLE_TEXT_COLUMNS} AND p.n_non_null > 0 GROUP BY p.table_idx""",
            "tabtext": """SELECT t.table_idx, 'Table: ' || t.table_name || coalesce(' | ' || x.parts, '') AS table_text
                 FROM tabs t LEFT JOIN tabparts x USING (table_idx)""",
            "ttok": f"SELECT table_idx, unnest(string_split_regex(lower(table_text), {split})) AS tok FROM tabtext",
            "tbag": f"""SELECT table_idx, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {dim} AS INTEGER) AS bucket,
                    count(*) AS weight FROM ttok WHERE tok <> '' GROUP BY ALL""",
            "ctok": f"SELECT table_idx, col_idx, unnest(string_split_regex(lower(column_text), {split})) AS tok FROM coltext",
            "cbag": f"""SELECT table_idx, col_idx, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {dim} AS INTEGER) AS bucket,
                    count(*) AS weight FROM ctok WHERE tok <> '' GROUP BY ALL""",
            "tnorm": "SELECT table_idx, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM tbag GROUP BY ALL",
            "tdot": """SELECT a.table_idx AS q_idx, b.table_idx AS c_idx, CAST(sum(a.weight * b.weight) AS DOUBLE) AS dot
                 FROM tbag a JOIN tbag b USING (bucket) GROUP BY ALL""",
            "tsem": f"""SELECT p.q_idx, p.c_idx,
                    CASE WHEN coalesce(na.norm, 0) < {NORM_EPSILON} OR coalesce(nb.norm, 0) < {NORM_EPSILON} THEN 0.0
                         ELSE greatest(0.0, least(1.0, coalesce(d.dot, 0.0) / (na.norm * nb.norm))) END AS semantic_table
                 FROM pairs p LEFT JOIN tnorm na ON na.table_idx = p.q_idx LEFT JOIN tnorm nb ON nb.table_idx = p.c_idx
                 LEFT JOIN tdot d ON d.q_idx = p.q_idx AND d.c_idx = p.c_idx""",
            "gated": f"SELECT q_idx, c_idx FROM tsem WHERE semantic_table >= {SEMANTIC_GATE}",
            "cnorm": "SELECT table_idx, col_idx, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM cbag GROUP BY ALL",
            "cdot": """SELECT a.table_idx AS q_idx, b.table_idx AS c_idx, a.col_idx AS q_col, b.col_idx AS c_col,
                    CAST(sum(a.weight * b.weight) AS DOUBLE) AS dot
                 FROM cbag a JOIN cbag b USING (bucket)
                 JOIN gated g ON g.q_idx = a.table_idx AND g.c_idx = b.table_idx
                 GROUP BY ALL""",
            "sm": f"""SELECT g.q_idx, g.c_idx, a.col_idx AS q_col, b.col_idx AS c_col,
                    CASE WHEN coalesce(na.norm, 0) < {NORM_EPSILON} OR coalesce(nb.norm, 0) < {NORM_EPSILON} THEN 0.0
                         ELSE greatest(0.0, least(1.0, coalesce(d.dot, 0.0) / (na.norm * nb.norm))) END AS s
                 FROM gated g JOIN prof a ON a.table_idx = g.q_idx JOIN prof b ON b.table_idx = g.c_idx
                 LEFT JOIN cnorm na ON na.table_idx = a.table_idx AND na.col_idx = a.col_idx
                 LEFT JOIN cnorm nb ON nb.table_idx = b.table_idx AND nb.col_idx = b.col_idx
                 LEFT JOIN cdot d ON d.q_idx = g.q_idx AND d.c_idx = g.c_idx AND d.q_col = a.col_idx AND d.c_col = b.col_idx""",
            "sm_o": _orient("sm"),
            "dims_g": "SELECT d.* FROM dims d JOIN gated USING (q_idx, c_idx)",
            "dps": _dp("dps", "sm_o", "dims_g"),
            "sem_total": _dp_total("dps", "dims_g"),
            "semantic": """SELECT d.q_idx, d.c_idx,
                    coalesce(m.mx, 0.0) AS semantic_join,
                    CASE WHEN t.total IS NULL OR d.lo = 0 THEN 0.0 ELSE t.total / d.lo END AS semantic_union
                 FROM dims d
                 LEFT JOIN (SELECT q_idx, c_idx, max(s) AS mx FROM sm GROUP BY ALL) m USING (q_idx, c_idx)
                 LEFT JOIN sem_total t USING (q_idx, c_idx)""",
            "scores": f"""SELECT p.q_idx, p.c_idx, j.joinability, u.unionability, t.semantic_table,
                    s.semantic_join, s.semantic_union
                 FROM pairs p JOIN joinability j USING (q_idx, c_idx) JOIN unionability u USING (q_idx, c_idx)
                 JOIN tsem t USING (q_idx, c_idx) JOIN semantic s USING (q_idx, c_idx)""",
            "cscores": f"""SELECT q_idx, c_idx, round(joinability, {CLEAN_DIGITS}) AS joinability,
                    round(unionability, {CLEAN_DIGITS}) AS unionability,
                    round(semantic_table, {CLEAN_DIGITS}) AS semantic_table,
                    round(semantic_join, {CLEAN_DIGITS}) AS semantic_join,
                    round(semantic_union, {CLEAN_DIGITS}) AS semantic_union FROM scores""",
            "lab": f"""SELECT q_idx, c_idx, greatest(joinability, unionability) AS similarity, joinability,
                    unionability, semantic_table, semantic_join, semantic_union,
                    CAST(joinability >= {JOIN_THRESHOLD} AND semantic_join >= {SEMANTIC_THRESHOLD} AS INTEGER) AS is_join_gt,
                    CAST(unionability >= {UNION_THRESHOLD} AND semantic_union >= {SEMANTIC_THRESHOLD} AS INTEGER) AS is_union_gt
                 FROM cscores""",
        }

    def sql(self, select: str, needs: list[str]) -> str:
        """``WITH RECURSIVE`` over the transitive closure of ``needs`` + ``select``."""
        ctes = self.ctes()
        order = list(ctes)
        want: set[str] = set()

        def visit(name):
            if name in want:
                return
            want.add(name)
            body = ctes[name]
            for other in order:
                if other != name and _mentions(body, other):
                    visit(other)

        for n in list(needs) + [c for c in order if _mentions(select, c)]:
            visit(n)
        parts = [f"{n} AS ({ctes[n]})" for n in order if n in want]
        return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def _mentions(body: str, name: str) -> bool:
    import re

    return re.search(rf"(?<![\w.]){re.escape(name)}(?![\w(])", body) is not None


def _orient(mat: str) -> str:
    """Rows = the narrower side, so a row assignment covers min(n_q, n_c) cells."""
    return f"""SELECT m.q_idx, m.c_idx,
                CASE WHEN d.n_q <= d.n_c THEN m.q_col ELSE m.c_col END AS r,
                CASE WHEN d.n_q <= d.n_c THEN m.c_col ELSE m.q_col END AS c, m.s
             FROM {mat} m JOIN dims d USING (q_idx, c_idx)"""


def _dp(name: str, mat: str, dims: str) -> str:
    return f"""SELECT q_idx, c_idx, 0 AS r, CAST(0 AS BIGINT) AS mask, 0.0::DOUBLE AS total FROM {dims}
             UNION ALL
             SELECT p.q_idx, p.c_idx, p.r + 1 AS r, p.mask | (CAST(1 AS BIGINT) << m.c) AS mask,
                    max(p.total + m.s) AS total
             FROM {name} p JOIN {mat} m ON m.q_idx = p.q_idx AND m.c_idx = p.c_idx AND m.r = p.r
             WHERE (p.mask & (CAST(1 AS BIGINT) << m.c)) = 0
             GROUP BY p.q_idx, p.c_idx, p.r + 1, p.mask | (CAST(1 AS BIGINT) << m.c)"""


def _dp_total(dp: str, dims: str) -> str:
    return f"""SELECT p.q_idx, p.c_idx, max(p.total) AS total FROM {dp} p JOIN {dims} d USING (q_idx, c_idx)
             WHERE p.r = d.lo GROUP BY ALL"""


def _named(select_cols: str, src: str, pair: bool = True) -> str:
    if pair:
        return (f"SELECT {select_cols} FROM {src} x JOIN tabs qt ON qt.table_idx = x.q_idx "
                f"JOIN tabs ct ON ct.table_idx = x.c_idx")
    return f"SELECT {select_cols} FROM {src} x JOIN tabs t ON t.table_idx = x.table_idx"


PAIR = "qt.table_name AS query_table, ct.table_name AS candidate_table"
R6 = 6
C = CLEAN_DIGITS


def queries_sql(tables: tuple[str, ...], schema_dir: str = SCHEMA_DIR) -> dict[str, str]:
    o = Oracle(lake_spec(tables, schema_dir))
    d = OUTPUT_DIGITS
    q = {
        "lake_cells": (_named("t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, c.column_name, x.value",
                              "cells", pair=False)
                       + " JOIN coldim c ON c.table_idx = x.table_idx AND c.col_idx = x.col_idx", ["cells", "coldim"]),
        "column_counts": (_named("t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, x.column_name, "
                                 "CAST(x.n_rows AS BIGINT) AS n_rows, CAST(x.n_non_null AS BIGINT) AS n_non_null",
                                 "prof", pair=False), ["prof"]),
        "type_inference": (_named("t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, x.column_name, x.inferred_type",
                                  "prof", pair=False), ["prof"]),
        "null_ratio": (_named(f"t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, round(round(x.null_ratio, {C}), {R6}) AS null_ratio",
                              "prof", pair=False), ["prof"]),
        "cardinality_ratio": (_named(f"t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, "
                                     f"CAST(x.n_distinct AS BIGINT) AS n_distinct, "
                                     f"round(round(x.cardinality_ratio, {C}), {R6}) AS cardinality_ratio", "prof", pair=False), ["prof"]),
        "top_values": (_named("t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, x.value, "
                              "CAST(x.freq AS BIGINT) AS freq, CAST(x.rank AS INTEGER) AS rank", "topv", pair=False), ["topv"]),
        "column_profile": (_named(f"t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, x.column_name, x.inferred_type, "
                                  f"round(round(x.cardinality_ratio, {C}), {R6}) AS cardinality_ratio, "
                                  f"round(round(x.null_ratio, {C}), {R6}) AS null_ratio, CAST(x.n_values AS INTEGER) AS n_values",
                                  "prof", pair=False), ["prof"]),
        "table_pairs": (_named(PAIR, "pairs"), ["pairs", "tabs"]),
        "value_overlap": (_named(f"{PAIR}, CAST(x.q_col AS INTEGER) AS q_col, CAST(x.c_col AS INTEGER) AS c_col, "
                                 "CAST(x.k AS BIGINT) AS k", "ov"), ["ov", "tabs"]),
        "column_containment": (_named(f"{PAIR}, CAST(x.q_col AS INTEGER) AS q_col, CAST(x.c_col AS INTEGER) AS c_col, "
                                      f"round(round(x.containment_q, {C}), {R6}) AS containment_q, "
                                      f"round(round(x.containment_c, {C}), {R6}) AS containment_c", "cont"), ["cont", "tabs"]),
        "joinability": (_named(f"{PAIR}, round(round(x.joinability, {C}), {R6}) AS joinability", "joinability"),
                        ["joinability", "tabs"]),
        "column_jaccard": (_named(f"{PAIR}, CAST(x.q_col AS INTEGER) AS q_col, CAST(x.c_col AS INTEGER) AS c_col, "
                                  f"round(round(x.jaccard, {C}), {R6}) AS jaccard", "jac") + " WHERE x.type_q = x.type_c",
                           ["jac", "tabs"]),
        "column_union_similarity": (_named(f"{PAIR}, CAST(x.q_col AS INTEGER) AS q_col, CAST(x.c_col AS INTEGER) AS c_col, "
                                           f"round(round(x.s, {C}), {R6}) AS similarity", "um"), ["um", "tabs"]),
        "coverage": (_named(f"{PAIR}, CAST(x.n_q AS INTEGER) AS n_q, CAST(x.n_c AS INTEGER) AS n_c, "
                            f"round(round(x.lo / x.hi, {C}), {R6}) AS coverage", "dims"), ["dims", "tabs"]),
        "unionability": (_named(f"{PAIR}, round(round(x.unionability, {C}), {R6}) AS unionability", "unionability"),
                         ["unionability", "tabs"]),
        "column_sample_values": (_named("t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, "
                                        "CAST(x.pos AS INTEGER) AS pos, x.value", "samp", pair=False), ["samp"]),
        "column_text": (_named("t.table_name, CAST(x.col_idx AS INTEGER) AS col_idx, x.column_text",
                               "coltext", pair=False), ["coltext"]),
        "table_text": (_named("t.table_name, x.table_text", "tabtext", pair=False), ["tabtext"]),
        "text_embedding": (_named("t.table_name, x.bucket, CAST(x.weight AS BIGINT) AS weight", "tbag", pair=False),
                           ["tbag"]),
        "table_semantic": (_named(f"{PAIR}, round(round(x.semantic_table, {C}), {R6}) AS semantic_table", "tsem"),
                           ["tsem", "tabs"]),
        "column_semantic": (_named(f"{PAIR}, CAST(x.q_col AS INTEGER) AS q_col, CAST(x.c_col AS INTEGER) AS c_col, "
                                   f"round(round(x.s, {C}), {R6}) AS cosine", "sm"), ["sm", "tabs"]),
        "semantic_join": (_named(f"{PAIR}, round(round(x.semantic_join, {C}), {R6}) AS semantic_join", "semantic"),
                          ["semantic", "tabs"]),
        "semantic_union": (_named(f"{PAIR}, round(round(x.semantic_union, {C}), {R6}) AS semantic_union", "semantic"),
                           ["semantic", "tabs"]),
        "pair_labels": (_named(f"{PAIR}, round(round(x.similarity, {C}), {d}) AS similarity, round(round(x.joinability, {C}), {d}) AS joinability, "
                               f"round(round(x.unionability, {C}), {d}) AS unionability, round(round(x.semantic_table, {C}), {d}) AS semantic_table, "
                               f"round(round(x.semantic_join, {C}), {d}) AS semantic_join, round(round(x.semantic_union, {C}), {d}) AS semantic_union, "
                               "x.is_join_gt, x.is_union_gt, greatest(x.is_join_gt, x.is_union_gt) AS is_ground_truth",
                               "lab"), ["lab", "tabs"]),
        "label_summary": ("SELECT CAST(sum(greatest(is_join_gt, is_union_gt)) AS BIGINT) AS positive_pairs, "
                          "count(*) AS total_pairs FROM lab", ["lab"]),
    }
    labels, needs = q["pair_labels"]
    q["labels_prefix"] = (labels + " WHERE x.q_idx < 4 AND x.c_idx < 6", needs)
    q["no_model_labels"] = (
        f"SELECT {PAIR}, round(round(greatest(x.joinability, u.unionability), {C}), {d}) AS similarity, "
        f"round(round(x.joinability, {C}), {d}) AS joinability, round(round(u.unionability, {C}), {d}) AS unionability, "
        "0.5::DOUBLE AS semantic_table, 0.0::DOUBLE AS semantic_join, 0.0::DOUBLE AS semantic_union, "
        "0 AS is_join_gt, 0 AS is_union_gt, 0 AS is_ground_truth FROM joinability x JOIN unionability u USING (q_idx, c_idx) "
        "JOIN tabs qt ON qt.table_idx = x.q_idx JOIN tabs ct ON ct.table_idx = x.c_idx", ["joinability", "unionability", "tabs"])
    q["best_containment"] = q["joinability"]
    q["token_ppmi"] = ("SELECT x AS a, y AS b, round(round(ln(n * total / (nx::DOUBLE * ny)), 12), 6) AS ppmi FROM weighed "
                       "WHERE x < y AND ln(n * total / (nx::DOUBLE * ny)) > 0", ["weighed"])
    out = {k: o.sql(sel, needs) for k, (sel, needs) in q.items()}
    listed = lake_spec(tables, schema_dir)
    out["load_manifest"] = " UNION ALL ".join(
        f"SELECT {i} AS table_idx, '{name}' AS table_name, 'ok' AS status, CAST(NULL AS VARCHAR) AS error, "
        f"count(*) AS footer_rows, count(*) AS rows_read FROM {view}" for i, (view, name, _) in enumerate(listed))
    out["lake_listing"] = "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{name}', {len(cols)}, 'ok')" for i, (_, name, cols) in enumerate(listed)) + ") AS t(table_idx, table_name, n_cols, status)"
    out["csv_profile"] = CSV_CELLS + CSV_PROFILE
    out["csv_top_values"] = CSV_CELLS + CSV_TOP
    out["vector_cosine"] = VECTOR_COSINE_SQL
    return out


# The cells of the CSV table after typing, written out by hand.
CSV_CELLS = """
WITH cell AS (
  SELECT c_custkey AS k, unnest([
    struct_pack(c := 'key', t := 'numeric', v := CAST(c_custkey AS VARCHAR)),
    struct_pack(c := 'nation', t := 'numeric', v := CASE WHEN c_custkey % 5 != 0 THEN CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) END),
    struct_pack(c := 'balance', t := 'numeric', v := CAST(CAST(printf('%.2f', CAST(c_acctbal AS DOUBLE)) AS DOUBLE) AS VARCHAR)),
    struct_pack(c := 'flag', t := 'numeric', v := CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END),
    struct_pack(c := 'nothing', t := 'string', v := NULL),
    struct_pack(c := 'note', t := 'string', v := CASE WHEN c_custkey % 3 != 0 THEN ' ' || c_mktsegment || ', x ' END)]) AS s
  FROM customer),
top AS (
  SELECT s.c AS c, trim(lower(s.v)) AS v, count(*) AS freq, row_number() OVER (PARTITION BY s.c ORDER BY count(*) DESC, min(k)) AS rank
  FROM cell WHERE s.v IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 200)
"""
CSV_PROFILE = """
SELECT s.c AS column_name, any_value(s.t) AS inferred_type, count(*) AS n_rows, count(s.v) AS n_non_null,
  count(DISTINCT s.v) AS n_distinct, CAST((SELECT count(*) FROM top WHERE top.c = cell.s.c) AS INTEGER) AS n_values,
  round(CASE WHEN count(s.v) > 0 THEN count(DISTINCT s.v) / count(s.v) ELSE 0.0 END, 6) AS cardinality_ratio,
  round(CASE WHEN count(s.v) > 0 THEN (count(*) - count(s.v)) / count(*) ELSE 1.0 END, 6) AS null_ratio
FROM cell GROUP BY s.c
"""
CSV_TOP = "SELECT c AS column_name, v AS value, freq, CAST(rank AS INTEGER) AS rank FROM top"

VECTOR_COSINE_SQL = f"""
WITH el AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings
), centroid AS (
  SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM el GROUP BY ALL
), parts AS (
  SELECT e.vec_id, e.label, sum(CAST(e.x AS DOUBLE) * c.m) AS dot, sum(CAST(e.x AS DOUBLE) * CAST(e.x AS DOUBLE)) AS vv
  FROM el e JOIN centroid c USING (label, d) GROUP BY ALL
), cn AS (
  SELECT label, sum(m * m) AS cc FROM centroid GROUP BY ALL
)
SELECT p.vec_id, p.label,
       round(round(CASE WHEN sqrt(p.vv) < {NORM_EPSILON} OR sqrt(cn.cc) < {NORM_EPSILON} THEN 0.0
                  ELSE greatest(0.0, least(1.0, p.dot / (sqrt(p.vv) * sqrt(cn.cc)))) END, 12), 6) AS cosine
FROM parts p JOIN cn USING (label)
"""
