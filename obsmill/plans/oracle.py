"""The same results as plain SQL over the star tables, for comparison.

Written independently of the operators: joins and correlated steps where the
operators aggregate, plain windows where they count.
"""

from __future__ import annotations

# Sums of doubles go through all digits of their shortest decimal text, so no order matters.


def _exact(value: str) -> str:
    return f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18))"


def _sum(value: str) -> str:
    return f"CAST(CAST(sum({_exact(value)}) AS VARCHAR) AS DOUBLE)"


_AREAS = "('NATION_3','NATION_8','NATION_15','NATION_20','NATION_21')"
_ITEMS = "('ECONOMY','LARGE','PROMO','SMALL')"
_M49 = '"Area Code (M49)"'
_CPC = '"Item Code (CPC)"'
_ALL = f'Domain, Area, {_M49}, Item, {_CPC}, Element, "Year", Months, Unit, Value'
_ROW = f'{_M49}, Item, {_CPC}'

_CODES = """lpad(CAST(nk + 100 AS VARCHAR), 3, '0')"""
_ITEM_CODE = """CASE WHEN Item = 'PROMO' THEN '''F1' ELSE '''01' || substr(Item, 1, 1) END"""


def _branch(domain: str, source: str, element: str, unit: str, value: str, where: str = "true",
            area: str = "Area", code: str = f"'''' || {_CODES}", months: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f"SELECT '{domain}' AS Domain, {area} AS Area, {code} AS {_M49}, Item, {_ITEM_CODE} AS {_CPC}, "
        f"'{element}' AS Element, \"Year\", {months} AS Months, {unit} AS Unit, {value} AS Value "
        f"FROM {source} WHERE {where}"
    )


_CTES = {
    "s": """
        SELECT n_nationkey AS nk, n_name AS Area, p_type AS Item,
               CAST(year(l_shipdate) AS INTEGER) AS "Year",
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS prod,
               CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS harv,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS val
        FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3, 4""",
    "m": """
        SELECT n_nationkey AS nk, n_name AS Area, p_type AS Item,
               CAST(year(l_shipdate) AS INTEGER) AS "Year", month(l_shipdate) AS mon,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
               / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3, 4, 5""",
    "c": """
        SELECT n_nationkey AS nk, n_name AS Area, p_type AS Item,
               CAST(year(l_shipdate) AS INTEGER) AS "Year",
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS prod,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS val
        FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3, 4""",
    "w": """SELECT -1 AS nk, Item, "Year", sum(CAST(prod AS DECIMAL(28,2)))::DOUBLE AS prod FROM s GROUP BY 2, 3""",
    "y": """
        SELECT nk, Area, Item, "Year", floor(prod * 1000 / harv) AS yld FROM s
        WHERE NOT (nk % 10 = 3 AND "Year" % 3 = 0)""",
    "qcl": " UNION ALL ".join(
        [
            _branch("QCL", "s", "Production", "'t'", "prod"),
            _branch("QCL", "w", "Production", "'t'", "prod", area="'World'", code="'''001'"),
            _branch("QCL", "s", "Area harvested", "'ha'", "harv", 'NOT (nk % 10 = 4 AND "Year" % 4 = 0)'),
            _branch("QCL", "y", "Yield", "'hg/ha'", "yld * 10", "nk % 3 = 0"),
            _branch("QCL", "y", "Yield", "'t/ha'", "yld / 1000", "nk % 3 = 1"),
            _branch("QCL", "y", "Yield", "'kg/ha'", "yld", "nk % 3 = 2"),
        ]
    ),
    "pp": " UNION ALL ".join(
        [
            _branch("PP", "s", "Producer Price (USD/tonne)", "'USD'", "val / prod", months="'Annual value'"),
            _branch("PP", "m", "Producer Price (USD/tonne)", "'USD'", "price", months="'M' || CAST(mon AS VARCHAR)"),
        ]
    ),
    "tcl": " UNION ALL ".join(
        [
            _branch("TCL", "s", "Export quantity", "'t'", "prod"),
            _branch("TCL", "s", "Export value", "'1000 USD'", "val"),
            _branch("TCL", "c", "Import quantity", "'t'", "prod", "nk <> 5"),
            _branch("TCL", "c", "Import value", "'1000 USD'", "val", "nk <> 5"),
        ]
    ),
    "obs": f"SELECT {_ALL} FROM qcl UNION ALL SELECT {_ALL} FROM pp UNION ALL SELECT {_ALL} FROM tcl",
    "crops": """SELECT * FROM qcl WHERE Area <> 'World'""",
    "ny": """
        SELECT * REPLACE (
          CASE WHEN Element = 'Yield' AND Unit = 'hg/ha' THEN Value * 0.1::DOUBLE
               WHEN Element = 'Yield' AND Unit = '100 mg/ha' THEN Value * 0.0001::DOUBLE
               WHEN Element = 'Yield' AND Unit = 't/ha' THEN Value * 1000 ELSE Value END AS Value,
          CASE WHEN Element = 'Yield' AND Unit IN ('hg/ha','100 mg/ha','t/ha') THEN 'kg/ha' ELSE Unit END AS Unit)
        FROM crops""",
    "paired": """
        SELECT u.Area, u.Item, u."Year", yy.Value AS yield_kg_ha, aa.Value AS harvested_ha
        FROM (SELECT DISTINCT Area, Item, "Year" FROM crops) u
        LEFT JOIN (SELECT * FROM ny WHERE Element = 'Yield') yy
          ON u.Area = yy.Area AND u.Item = yy.Item AND u."Year" = yy."Year"
        LEFT JOIN (SELECT * FROM ny WHERE Element = 'Area harvested') aa
          ON u.Area = aa.Area AND u.Item = aa.Item AND u."Year" = aa."Year" """,
    "items": f"""
        SELECT DISTINCT Item FROM qcl
        WHERE Element = 'Area harvested' AND NOT contains({_CPC}, 'F')""",
    "rel": f"""
        SELECT {_ALL} FROM obs
        WHERE Item IN (SELECT Item FROM items) AND (Domain <> 'PP' OR Months = 'Annual value')""",
    "avail": """
        SELECT Area, Item, list_sort(list(DISTINCT "Year")) AS yrs, bool_or(Element = 'Area harvested') AS harvested
        FROM qcl WHERE Item IN (SELECT Item FROM items) GROUP BY 1, 2""",
    "meta": """
        SELECT Domain AS code, 'Domain ' || Domain AS name, CAST(max("Year") AS VARCHAR) || '-12-31' AS updated,
               'star tables' AS source, 'https://data.example.org/' || Domain || '.zip' AS url, count(*) AS rows
        FROM obs GROUP BY Domain""",
    "lookup": """
        SELECT CAST(n_nationkey + 100 AS INTEGER) AS M49, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ISO3,
               r_name AS Continent, r_name || '-' || CAST(n_nationkey % 2 AS VARCHAR) AS Region
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <= 22""",
    "geo": f"""
        SELECT a.Area, a.{_M49}, a.M49, l.ISO3, coalesce(l.Continent, 'Unclassified') AS Continent,
               coalesce(l.Region, 'Unclassified') AS Region
        FROM (SELECT DISTINCT Area, {_M49}, TRY_CAST(ltrim({_M49}, '''') AS INTEGER) AS M49 FROM qcl) a
        LEFT JOIN lookup l ON a.M49 = l.M49""",
    "countries": "SELECT Area, M49, ISO3, Continent, Region FROM geo WHERE ISO3 IS NOT NULL",
}
_NEEDS = {
    "w": ["s"], "y": ["s"], "qcl": ["s", "w", "y"], "pp": ["s", "m"], "tcl": ["s", "c"],
    "obs": ["qcl", "pp", "tcl"], "crops": ["qcl"], "ny": ["crops"], "paired": ["crops", "ny"],
    "items": ["qcl"], "rel": ["obs", "items"], "avail": ["qcl", "items"], "meta": ["obs"],
    "geo": ["qcl", "lookup"], "countries": ["geo"],
}


def _sql(body: str, *needs: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        add(name)
    extra = "" if not wanted else "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in wanted) + "\n"
    return extra + body


def _weighted(groups: str, frame: str = "paired") -> str:
    """Weighted yield per group: published value, complete coverage, or null."""
    return f"""
        SELECT {groups}, 'kg/ha' AS Unit,
          CASE WHEN count(*) = 1 THEN max(yield_kg_ha)
               WHEN bool_and(coalesce(yield_kg_ha IS NOT NULL AND harvested_ha > 0, false))
               THEN {_sum('yield_kg_ha * harvested_ha')} / {_sum('harvested_ha')} END AS Value
        FROM {frame} GROUP BY {groups}"""


def _total(element: str, groups: str, frame: str = "crops") -> str:
    return (
        f"SELECT {groups}, Unit, {_sum('Value')} AS Value FROM {frame} "
        f"WHERE Element = '{element}' GROUP BY {groups}, Unit"
    )


def _change(cur: str, prev: str) -> str:
    return f"({cur} - {prev}) / abs(nullif({prev}, 0)) * 100"


def _ends(source: str, series: str) -> str:
    return f"""
        SELECT {series}, min("Year") AS first_year, max("Year") AS last_year,
               arg_min(Value, "Year") AS first_value, arg_max(Value, "Year") AS last_value,
               count(*) AS n_years
        FROM ({source}) WHERE Value IS NOT NULL GROUP BY {series}"""


_YOY = """
    SELECT {keys}, cur."Year", cur.Value, prv.Value AS previous, {change} AS change_pct
    FROM ({source}) cur LEFT JOIN ({source}) prv ON {same} AND prv."Year" = cur."Year" - 1"""


def _yoy(source: str, keys: list[str]) -> str:
    return _YOY.format(
        keys=", ".join(f"cur.{k}" for k in keys),
        same=" AND ".join(f"cur.{k} = prv.{k}" for k in keys),
        change=_change("cur.Value", "prv.Value"),
        source=source,
    )


_SERIES = """Element, Area || ' · ' || Item AS series, Area, Item, "Year", Unit, Value, CAST(NULL AS VARCHAR) AS flag"""
_ROLLED = """series, CAST(NULL AS VARCHAR) AS Area, series AS Item, "Year", Unit, Value,
    'Local aggregate of official observations' AS flag"""
_CHOSEN = f"Area IN {_AREAS} AND Item IN {_ITEMS} AND \"Year\" BETWEEN 1996 AND 1999"
_YIELD_BY_AREA = _weighted('Area, "Year"')

_WORLD_ROWS = f"""SELECT Item, "Year", Value FROM qcl WHERE Area = 'World' AND Element = 'Production'"""
_SHARE = f"""
    SELECT p.Area, p."Year", p.Unit, p.Value, w.v AS world_value,
           p.Value / (CASE WHEN w.v > 0 THEN w.v END) * 100 AS share_pct
    FROM ({_total('Production', 'Area, "Year"')}) p JOIN countries c ON p.Area = c.Area
    LEFT JOIN (SELECT "Year", {_sum('Value')} AS v FROM ({_WORLD_ROWS}) GROUP BY 1) w ON p."Year" = w."Year" """


def _ranked(source: str, by: str, share: bool = True) -> str:
    # A cast cannot stand between an aggregate and its OVER clause.
    over = f"CAST(CAST(sum({_exact('Value')}) OVER (PARTITION BY {by}) AS VARCHAR) AS DOUBLE)"
    extra = f", Value / (CASE WHEN {over} > 0 THEN {over} END) * 100 AS share_pct" if share else ""
    return f"""
        SELECT *, CAST(rank() OVER (PARTITION BY {by} ORDER BY Value DESC) AS BIGINT) AS rank {extra}
        FROM ({source}) WHERE Value IS NOT NULL"""


def _top(source: str, by: str, n: int) -> str:
    return f"""
        SELECT * EXCLUDE (position) FROM (
          SELECT *, CAST(rank() OVER (PARTITION BY {by} ORDER BY Value DESC) AS BIGINT) AS rank,
                 row_number() OVER (PARTITION BY {by} ORDER BY Value DESC, Area) AS position
          FROM ({source}) WHERE Value IS NOT NULL) WHERE position <= {n}"""


def _kpis(areas: str, items: str, last: int, before: int | None, single: str | None) -> str:
    """Six figures; `single` names the area when exactly one area and item are chosen."""
    prev = "NULL" if before is None else str(before)
    scope = f"Area IN {areas} AND Item IN {items}"

    def made(element: str, year: str) -> str:
        return (
            f"(SELECT {_sum('Value')} FROM crops WHERE {scope} AND Element = '{element}' "
            f"AND \"Year\" = {year})"
        )

    chosen = f"(SELECT * FROM paired WHERE {scope})"
    yields = _weighted('"Year"', chosen)

    def yielded(year: str) -> str:
        return f"(SELECT max(Value) FROM ({yields}) WHERE \"Year\" = {year})"

    world = (
        f"(SELECT {_sum('Value')} FROM qcl WHERE Area = 'World' AND Element = 'Production' "
        f"AND Item IN {items} AND \"Year\" = {last})"
    )
    price = rank = "CAST(NULL AS DOUBLE)"
    if single:
        price = (
            f"(SELECT CASE WHEN count(Value) = 1 THEN max(Value) END FROM pp WHERE {scope} "
            f"AND Months = 'Annual value' AND \"Year\" = {last})"
        )
        ranked = _ranked(
            f"SELECT t.* FROM ({_total('Production', 'Area')}) t JOIN countries c ON t.Area = c.Area", "Unit", False
        ).replace("WHERE Element = 'Production'", f"WHERE Element = 'Production' AND Item IN {items} AND \"Year\" = {last}")
        rank = f"CAST((SELECT max(rank) FROM ({ranked}) WHERE Area = '{single}') AS DOUBLE)"

    def change(now: str, then: str) -> str:
        return _change(now, then) if before is not None else "CAST(NULL AS DOUBLE)"

    p, a, y = (made("Production", str(last)), made("Area harvested", str(last)), yielded(str(last)))
    return f"""
        SELECT 'production' AS kpi, {p} AS value, 't' AS unit, {change(p, made('Production', prev))} AS change_pct
        UNION ALL SELECT 'harvested_area', {a}, 'ha', {change(a, made('Area harvested', prev))}
        UNION ALL SELECT 'yield', {y}, 'kg/ha', {change(y, yielded(prev))}
        UNION ALL SELECT 'producer_price', {price}, 'USD/t', CAST(NULL AS DOUBLE)
        UNION ALL SELECT 'world_production_share', {p} / nullif({world}, 0) * 100, '%', CAST(NULL AS DOUBLE)
        UNION ALL SELECT 'world_rank', {rank}, 'rank', CAST(NULL AS DOUBLE)"""


def _questions() -> str:
    growth = "".join(
        f"""
        UNION ALL SELECT 'growth', '{e}', NULL, NULL, NULL, first_year, last_year,
            {_change('last_value', 'first_value')}, NULL
        FROM ({_ends(f"SELECT 1 AS one, * FROM ({src})", 'one')}) WHERE n_years > 1"""
        for e, src in (
            ("Production", _total("Production", '"Year"')),
            ("Yield", _weighted('"Year"')),
            ("Area harvested", _total("Area harvested", '"Year"')),
        )
    )
    top = "".join(
        f"""
        UNION ALL SELECT 'top', '{e}', Area, Value, Unit, NULL, "Year", NULL, NULL
        FROM ({_top(f"SELECT * FROM ({src}) WHERE \"Year\" = 1999", '"Year"', 1)})"""
        for e, src in (
            ("Production", _total("Production", 'Area, "Year"')),
            ("Yield", _YIELD_BY_AREA),
            ("Area harvested", _total("Area harvested", 'Area, "Year"')),
        )
    )
    return f"""
        SELECT q.conv_id, q.turn, q.intent, q.element, a.answer_area, a.answer_value, a.answer_unit,
               a.from_year, a.to_year, a.change_pct, a.n_rows
        FROM (
          SELECT conv_id, turn,
            CASE WHEN t LIKE '%productor%' THEN 'Production' WHEN t LIKE '%rendimiento%' THEN 'Yield'
                 ELSE 'Area harvested' END AS element,
            CASE WHEN t LIKE '%creci%' OR t LIKE '%aument%' THEN 'growth'
                 WHEN t LIKE '%mayor%' OR t LIKE '%ranking%' OR t LIKE '%rendimiento%' THEN 'top'
                 ELSE 'count' END AS intent
          FROM (SELECT conv_id, turn, lower(
                  CASE conv_id % 5 WHEN 0 THEN '¿Cuál fue el mayor productor? '
                       WHEN 1 THEN '¿Cuánto creció el rendimiento? ' WHEN 2 THEN 'Ranking por favor. '
                       WHEN 3 THEN '¿Ha aumentado? ' ELSE '' END || text) AS t
                FROM conversations WHERE role = 'user') WHERE regexp_matches(t, '[^\\s]')
        ) q LEFT JOIN (
          SELECT 'count' AS intent, e.element, CAST(NULL AS VARCHAR) AS answer_area, CAST(NULL AS DOUBLE) AS answer_value,
                 CAST(NULL AS VARCHAR) AS answer_unit, CAST(NULL AS INTEGER) AS from_year,
                 CAST(NULL AS INTEGER) AS to_year, CAST(NULL AS DOUBLE) AS change_pct,
                 (SELECT count(*) FROM crops) AS n_rows
          FROM (VALUES ('Production'), ('Yield'), ('Area harvested')) e(element)
          {growth} {top}
        ) a ON q.intent = a.intent AND q.element = a.element"""


_SAFE = "CASE WHEN regexp_matches({0}, '^[\\s]*[=+@-]') THEN '''' || {0} ELSE {0} END"
_PRICE_ROWS = """SELECT * FROM pp WHERE Months = 'Annual value'"""
_TRADE_ROWS = "SELECT * FROM tcl"
_CONTAINS = "contains(upper(coalesce(CAST({} AS VARCHAR), '')), '{}')"


def _spelled(value: str) -> str:
    """A double as its sign and five whole numbers of 31 bits, as in the text that fingerprints are made of."""
    parts, rest = [], f"(abs({value}) / 2147483648e0)"
    for _ in range(5):
        parts.append(f"floor({rest})::BIGINT::VARCHAR")
        rest = f"(({rest} - floor({rest})) * 2147483648e0)"
    return f"(CASE WHEN {value} < 0 THEN '-' ELSE '+' END || concat_ws(':', {', '.join(parts)}))"


def _fingerprint() -> str:
    """The sums of both halves of the rows' MD5."""
    names = sorted(c.strip().strip('"') for c in _ALL.split(","))
    texts = {f'"{c}"': _spelled("Value") if c == "Value" else f'"{c}"::VARCHAR' for c in names}
    cells = [f"CASE WHEN {c} IS NULL THEN 'n' ELSE strlen({t})::VARCHAR || ':' || {t} END" for c, t in texts.items()]
    halves = [f"sum(('0x' || substr(h, {at}, 16))::UBIGINT::HUGEINT)::VARCHAR" for at in (1, 17)]
    return f"""
        SELECT Domain, Item, count(*) AS n_rows, {halves[0]} || '-' || {halves[1]} AS fingerprint
        FROM (SELECT Domain, Item, md5({' || '.join(cells)}) AS h FROM rel) GROUP BY Domain, Item"""


_EDITED = f"""
    SELECT {_ALL.replace(' Value', '')} CASE WHEN Domain = 'TCL' AND Item = 'SMALL' AND Area = 'NATION_3'
           AND Element = 'Export value' THEN Value + 1 ELSE Value END AS Value
    FROM rel WHERE NOT (Domain = 'PP' AND Item = 'ECONOMY')"""


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}

    # Ingest, catalog, release
    q["ingest_csv"] = q["domain_store"] = q["typed_observations"] = _sql(f"SELECT {_ALL} FROM obs", "obs")
    q["bad_value_report"] = """
        SELECT doc_id, 'Year' AS bad_column, CAST(n_chars AS VARCHAR) AS bad_cell FROM documents
        WHERE n_chars IS NOT NULL AND TRY_CAST(CAST(n_chars AS VARCHAR) AS INTEGER) IS NULL
        UNION ALL SELECT doc_id, 'Value', text FROM documents
        WHERE text IS NOT NULL AND TRY_CAST(text AS DOUBLE) IS NULL"""
    q["catalog_rows"] = _sql(
        """SELECT code, CASE WHEN code = 'PP' THEN 'Producer prices' ELSE name END AS name, updated, url FROM meta
           UNION ALL SELECT 'FBS', 'Food balances', '2030-01-01', 'https://data.example.org/FBS.zip'
           UNION ALL SELECT 'RL', 'Land use', 'Not stated', ''""", "meta"
    )
    q["stale_domains"] = _sql(
        """SELECT m.code, m.updated AS catalog_updated, h.updated AS release_updated,
                  m.updated IS DISTINCT FROM h.updated AS stale
           FROM meta m LEFT JOIN (
             SELECT Domain AS code, CAST(max("Year") AS VARCHAR) || '-12-31' AS updated FROM obs
             WHERE Domain = 'PP' OR "Year" <= 2000 GROUP BY 1) h ON m.code = h.code""", "meta"
    )
    q["url_host_filter"] = """
        SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
               lower(regexp_extract(url, '^[^:/?#]+://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host,
               coalesce(lower(url) LIKE 'https://blog.tionsh.example.net/%'
                        OR lower(url) = 'https://blog.tionsh.example.net', false) AS accepted
        FROM pages"""
    q["release_rows"] = _sql(f"SELECT {_ALL} FROM rel", "rel")
    q["primary_items"] = _sql("SELECT Item FROM items", "items")
    q["area_table"] = _sql(f"SELECT DISTINCT Area, {_M49} FROM qcl", "qcl")
    q["availability"] = _sql(
        "SELECT Area, Item, array_to_string(yrs, ',') AS \"Years\", harvested FROM avail", "avail"
    )
    q["partition_manifest"] = _sql("SELECT Domain, Item, count(*) AS n_rows FROM rel GROUP BY 1, 2", "rel")
    q["partition_fingerprint"] = _sql(_fingerprint(), "rel")
    q["release_update"] = _sql(
        f"""SELECT Domain, count(*) AS left_rows, count(*) AS right_rows,
                  CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right
           FROM ({_EDITED}) GROUP BY Domain""", "rel"
    )
    q["differing_items"] = _sql(
        f"""SELECT coalesce(s.Domain, a.Domain) AS Domain, coalesce(s.Item, a.Item) AS Item, s.n AS stored_rows, a.n AS actual_rows,
             CASE WHEN a.n IS NULL THEN 'missing' ELSE 'content' END AS problem
           FROM (SELECT Domain, Item, count(*) AS n FROM rel GROUP BY 1, 2) s
           LEFT JOIN (SELECT Domain, Item, count(*) AS n FROM ({_EDITED}) GROUP BY 1, 2) a ON s.Domain = a.Domain AND s.Item = a.Item
           WHERE a.n IS NULL OR (s.Domain, s.Item) IN (
             SELECT (Domain, Item) FROM (SELECT {_ALL} FROM rel EXCEPT ALL ({_EDITED})))""", "rel"
    )
    q["manifest_mismatches"] = _sql(
        f"""SELECT * FROM (WITH act AS (
             SELECT {_ALL.replace(' Value', '')} CASE WHEN Domain = 'TCL' AND Item = 'SMALL' AND Area = 'NATION_3'
                    AND Element = 'Export value' THEN Value + 1 ELSE Value END AS Value
             FROM rel WHERE NOT (Domain = 'PP' AND Item = 'ECONOMY')
             UNION ALL SELECT {_ALL} FROM rel WHERE Domain = 'QCL' AND Item = 'LARGE'
             UNION ALL SELECT {_ALL} FROM obs WHERE Domain = 'TCL' AND Item = 'PROMO'),
           s AS (SELECT Domain, Item, count(*) AS n FROM rel GROUP BY 1, 2),
           a AS (SELECT Domain, Item, count(*) AS n FROM act GROUP BY 1, 2),
           d AS (SELECT DISTINCT Domain, Item FROM (SELECT {_ALL} FROM rel EXCEPT ALL SELECT {_ALL} FROM act)),
           labelled AS (
             SELECT coalesce(s.Domain, a.Domain) AS Domain, coalesce(s.Item, a.Item) AS Item,
                    s.n AS stored_rows, a.n AS actual_rows,
                    CASE WHEN a.n IS NULL THEN 'missing' WHEN s.n IS NULL THEN 'extra' WHEN s.n <> a.n THEN 'rows'
                         WHEN d.Item IS NOT NULL THEN 'content' END AS problem
             FROM s FULL JOIN a ON s.Domain = a.Domain AND s.Item = a.Item
             LEFT JOIN d ON s.Domain = d.Domain AND s.Item = d.Item)
           SELECT * FROM labelled WHERE problem IS NOT NULL)""", "rel"
    )
    q["release_parity"] = _sql(
        """SELECT Domain, count(*) AS left_rows, count(*) AS right_rows,
                  CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right
           FROM rel GROUP BY Domain""", "rel"
    )
    q["release_differences"] = _sql(
        f"""SELECT {_ALL}, count(*) AS surplus
            FROM (SELECT {_ALL} FROM obs EXCEPT ALL SELECT {_ALL} FROM rel) GROUP BY ALL""", "rel"
    )

    # Selection
    q["select_observations"] = _sql(
        f"SELECT {_ALL} FROM qcl WHERE {_CHOSEN} AND Element IN ('Production','Yield')", "qcl"
    )
    q["select_empty_items"] = _sql(f"SELECT {_ALL} FROM obs WHERE false", "obs")
    q["annual_prices"] = _sql(f"SELECT {_ALL} FROM pp WHERE Months = 'Annual value' AND {_CHOSEN}", "pp")
    q["available_items"] = _sql(
        f"SELECT DISTINCT Item FROM avail WHERE harvested AND Area IN {_AREAS}", "avail"
    )
    q["items_with_rows"] = _sql("SELECT DISTINCT Item FROM rel WHERE Domain = 'TCL'", "rel")
    q["available_years"] = _sql(
        f"""SELECT DISTINCT "Year" FROM qcl WHERE Area IN ('NATION_3','NATION_8') AND Item IN {_ITEMS}
            AND Item IN (SELECT Item FROM items)""", "items"
    )
    q["years_on_record"] = _sql(
        f"""SELECT DISTINCT "Year" FROM tcl WHERE Area IN {_AREAS} AND Item IN {_ITEMS}
            AND Element = 'Import value'""", "tcl"
    )
    q["domain_dimensions"] = _sql(
        " UNION ALL ".join(
            f"""SELECT Domain, '{kind}' AS dimension, {col} AS member, min("Year") AS min_year,
                       max("Year") AS max_year FROM obs GROUP BY 1, 3"""
            for kind, col in (("all", "NULL"), ("area", "Area"), ("item", "Item"), ("element", "Element"))
        ), "obs"
    )
    q["bitmap_items"], q["bitmap_years"] = q["available_items"], q["available_years"]
    q["bitmap_trade_years"] = _sql(
        f"""SELECT DISTINCT "Year" FROM rel WHERE Domain = 'TCL' AND Area IN {_AREAS} AND Item IN {_ITEMS}
            AND Element = 'Import value' AND "Year" IS NOT NULL""", "rel"
    )
    q["bitmap_items_in_period"] = _sql(
        """SELECT DISTINCT Item FROM tcl WHERE Area = 'NATION_3' AND Element = 'Export value'
           AND "Year" BETWEEN 1996 AND 1999 AND Item IS NOT NULL""", "tcl"
    )
    q["bitmap_members"] = _sql(
        " UNION ALL ".join(
            f"""SELECT Domain, '{kind}' AS dimension, {col} AS member, min("Year") AS min_year, max("Year") AS max_year,
                       count(DISTINCT "Year") AS n_years FROM obs WHERE {kept} GROUP BY 1, 3"""
            for kind, col, kept in (
                ("all", "NULL", "true"),
                *((c.lower(), c, f"{c} IS NOT NULL") for c in ("Area", "Item", "Element")),
            )
        ), "obs"
    )
    q["scope_areas"] = _sql(
        "SELECT * FROM countries WHERE Continent = 'EUROPE' AND Region = 'EUROPE-1'", "countries"
    )
    q["default_period"] = _sql(
        """SELECT Area, coalesce(min("Year") FILTER ("Year" >= 2000), min("Year")) AS from_year,
                  max("Year") AS to_year FROM crops WHERE Element = 'Area harvested' GROUP BY 1""", "crops"
    )
    q["default_item"] = _sql(
        """SELECT Area, CASE WHEN bool_or(Item = 'MEDIUM') THEN 'MEDIUM' ELSE min(Item) END AS Item
           FROM avail WHERE harvested GROUP BY 1""", "avail"
    )
    q["literal_search"] = "SELECT * FROM documents WHERE " + " OR ".join(
        _CONTAINS.format(c, "TION OF") for c in ("doc_id", "text", "lang", "source", "n_chars")
    )
    q["indexed_search"] = q["literal_search"]
    q["literal_search_observations"] = _sql(
        f"SELECT {_ALL} FROM obs WHERE "
        + " OR ".join(_CONTAINS.format(c.strip(), "33.3") for c in _ALL.split(",")), "obs"
    )
    q["literal_search_digits"] = """
        SELECT l_orderkey, l_linenumber, l_quantity / 7 AS part FROM lineitem
        WHERE contains(CAST(l_quantity / 7 AS VARCHAR), '285714285714286')
           OR contains(CAST(l_orderkey AS VARCHAR), '285714285714286')"""
    digits = ", ".join(
        f"printf('%.12e', CAST(CAST(sum(CAST(CAST(l_quantity AS DECIMAL(9,2)) AS DECIMAL(38,2))) AS VARCHAR) AS DOUBLE) {how}) AS {name}"
        for name, how in (("tiny", "* 1e-13"), ("third", "/ 3"), ("huge", "/ 3 * 1e16"))
    )
    q["total_of_small_values"] = f"SELECT l_returnflag, {digits} FROM lineitem GROUP BY 1"

    # Measures
    q["paired_yield_area"] = _sql("SELECT * FROM paired", "paired")
    q["duplicate_observations"] = _sql(
        """SELECT Area, Item, "Year", CAST(2 AS BIGINT) AS n_yield, CAST(count(harvested_ha) AS BIGINT) AS n_area
           FROM paired WHERE yield_kg_ha IS NOT NULL GROUP BY 1, 2, 3""", "paired"
    )
    q["kpi_totals"] = _sql(
        f"""SELECT "Year", CAST(CAST(sum({_exact('Value')}) FILTER (Element = 'Production') AS VARCHAR) AS DOUBLE) AS production_t,
                   CAST(CAST(sum({_exact('Value')}) FILTER (Element = 'Area harvested') AS VARCHAR) AS DOUBLE) AS harvested_ha
            FROM crops GROUP BY 1""", "crops"
    )
    q["production_by_area_year"] = _sql(_total("Production", 'Area, "Year"'), "crops")
    q["area_by_item_year"] = _sql(_total("Area harvested", 'Item, "Year"'), "crops")
    q["total_by_year"] = _sql(_total("Production", '"Year"'), "crops")
    q["normalized_yields"] = _sql(f"SELECT {_ALL} FROM ny", "ny")
    q["weighted_yield_by_year"] = _sql(_weighted('"Year"'), "paired")
    q["weighted_yield_by_area"] = _sql(_weighted("Area"), "paired")
    q["weighted_yield_by_area_year"] = _sql(_YIELD_BY_AREA, "paired")
    q["weighted_yield_by_item_year"] = _sql(_weighted('Item, "Year"'), "paired")
    q["yield_coverage"] = _sql(
        """SELECT "Year", count(*) AS n_rows, count(yield_kg_ha) AS n_yield, count(harvested_ha) AS n_area,
                  count(*) FILTER (harvested_ha > 0) AS n_positive_area FROM paired GROUP BY 1""", "paired"
    )
    q["series_guard"] = _sql(
        """SELECT Domain, Element, count(DISTINCT Area || ' · ' || Item) AS n_series,
                  count(DISTINCT CASE WHEN Element = 'Yield' THEN 'kg/ha' ELSE Unit END) AS n_units,
                  count(DISTINCT Area) AS n_areas, count(DISTINCT Item) AS n_items, count(Value) AS n_values
           FROM obs GROUP BY 1, 2""", "obs"
    )
    q["selection_count"] = _sql(
        f"SELECT Domain, count(*) AS n_rows FROM obs WHERE {_CHOSEN} GROUP BY 1", "obs"
    )
    q["observation_coverage"] = _sql(
        """SELECT Domain, Element, Item, count(*) AS n_rows, count(Value) AS n_values
           FROM obs GROUP BY 1, 2, 3""", "obs"
    )

    # Change over time
    q["yoy_change"] = _sql(_yoy(_YIELD_BY_AREA, ["Area", "Unit"]), "paired")
    q["yoy_change_production"] = _sql(
        _yoy(_total("Production", 'Area, Item, "Year"'), ["Area", "Item", "Unit"]), "crops"
    )
    q["period_change"] = _sql(
        f"""SELECT *, CASE WHEN n_years > 1 THEN {_change('last_value', 'first_value')} END AS change_pct
            FROM ({_ends(_YIELD_BY_AREA, 'Area')})""", "paired"
    )
    q["series_cagr"] = _sql(
        f"""SELECT *, CASE WHEN last_year > first_year AND first_value > 0 AND last_value >= 0
              THEN round((pow(last_value / first_value, 1.0::DOUBLE / (last_year - first_year)) - 1) * 100, 6)
              END AS cagr_pct
            FROM ({_ends(_total('Production', 'Item, "Year"'), 'Item')})""", "crops"
    )

    # Geography
    q["geo_lookup"] = _sql("SELECT * FROM lookup", "lookup")
    q["enriched_geography"] = _sql("SELECT * FROM geo", "geo")
    q["country_areas"] = _sql("SELECT * FROM countries", "countries")
    q["map_values"] = _sql(
        f"""SELECT v.Area, v."Year", v.Unit, v.Value, c.ISO3,
                   greatest(max(v.Value) OVER (PARTITION BY v."Year"), 1) AS color_max
            FROM ({_YIELD_BY_AREA}) v JOIN countries c ON v.Area = c.Area WHERE v.Value IS NOT NULL""",
        "paired", "countries",
    )

    # Rankings and shares
    country = "SELECT t.* FROM ({}) t JOIN countries c ON t.Area = c.Area"
    flag = f"SELECT *, Area IN {_AREAS} AS in_selection FROM ({{}})"
    q["world_ranking"] = _sql(
        flag.format(_ranked(country.format(_YIELD_BY_AREA) + ' WHERE t."Year" = 1999', '"Year", Unit')),
        "paired", "countries",
    )
    q["rank_all_years"] = _sql(
        flag.format(_ranked(country.format(_total("Area harvested", 'Area, "Year"')), '"Year", Unit')),
        "crops", "countries",
    )
    q["scope_ranking"] = _sql(
        _ranked(
            f"""SELECT Area, "Year", Unit, {_sum('Value')} AS Value FROM crops
                WHERE Element = 'Production' AND "Year" = 1999 AND Area IN {_AREAS} AND Item IN {_ITEMS}
                GROUP BY 1, 2, 3""", '"Year", Unit', share=False,
        ), "crops",
    )
    q["shares_and_ranks"] = _sql(
        _ranked(
            "SELECT Area, Item, \"Year\", Unit, Value FROM crops WHERE Element = 'Area harvested'",
            'Item, "Year", Unit',
        ), "crops",
    )
    q["top_n_ranking"] = _sql(_top(_total("Area harvested", 'Area, "Year"'), '"Year", Unit', 5), "crops")
    q["production_share"] = _sql(_SHARE, "crops", "countries")
    q["top_n_share"] = _sql(_top(_SHARE, '"Year"', 5), "crops", "countries")
    q["top_area"] = _sql(
        f"""SELECT "Year", Unit, Area, Value FROM ({_top(_total('Area harvested', 'Area, "Year"'), '"Year", Unit', 1)})""",
        "crops",
    )
    q["kpi_price"] = _sql(
        f"""SELECT Area, Item, "Year", CASE WHEN count(Value) = 1 THEN max(Value) END AS price
            FROM ({_PRICE_ROWS}) WHERE Area IN {_AREAS} AND Item IN {_ITEMS} GROUP BY 1, 2, 3""", "pp"
    )
    q["kpi_price_by_area"] = _sql(
        f"""SELECT Area, CASE WHEN count(Value) = 1 THEN max(Value) END AS price
            FROM ({_PRICE_ROWS}) WHERE Area IN {_AREAS} AND Item = 'ECONOMY' GROUP BY 1""", "pp"
    )

    # Trade and prices
    q["trade_balance"] = _sql(
        """SELECT coalesce(e.Area, i.Area) AS Area, coalesce(e.Item, i.Item) AS Item,
                  coalesce(e."Year", i."Year") AS "Year", coalesce(e.Unit, i.Unit) AS Unit,
                  e.Value AS export_value, i.Value AS import_value, e.Value - i.Value AS trade_balance
           FROM (SELECT * FROM tcl WHERE Element = 'Export value') e
           FULL JOIN (SELECT * FROM tcl WHERE Element = 'Import value') i
             ON e.Area = i.Area AND e.Item = i.Item AND e."Year" = i."Year" AND e.Unit = i.Unit""", "tcl"
    )
    by_item = f"""SELECT Element, Item, "Year", Unit, {_sum('Value')} AS Value FROM tcl GROUP BY 1, 2, 3, 4"""
    q["trade_by_item"] = _sql(by_item, "tcl")
    rolled = by_item.replace("FROM tcl", f"FROM ({_TRADE_ROWS})").replace(" Item,", " Item AS series,")
    q["trade_series"] = _sql(f"SELECT {_SERIES} FROM ({_TRADE_ROWS})", "tcl")
    q["trade_series_rollup"] = _sql(f"SELECT Element, {_ROLLED} FROM ({rolled})", "tcl")
    q["price_series"] = _sql(f"SELECT {_SERIES} FROM ({_PRICE_ROWS})", "pp")

    # Reports
    q["history_series"] = _sql(f"SELECT {_SERIES} FROM ny WHERE Element = 'Yield' AND {_CHOSEN}", "ny")
    q["history_series_all"] = _sql(f"SELECT {_SERIES} FROM ny WHERE Element = 'Yield'", "ny")
    q["history_series_rollup"] = _sql(
        f"""SELECT 'Yield' AS Element, {_ROLLED}
            FROM (SELECT Item AS series, "Year", Unit, Value FROM ({_weighted('Item, "Year"')}))""", "paired"
    )
    q["kpi_summary"] = _sql(
        _kpis("('NATION_20')", "('ECONOMY')", 1999, 1998, "NATION_20"), "paired", "countries", "pp"
    )
    q["stored_kpi_summary"] = q["kpi_summary"]
    primary = "(SELECT * FROM {} WHERE Item IN (SELECT Item FROM items))"
    q["stored_yields"] = _sql(_weighted('Area, "Year"', primary.format("paired")), "paired", "items")
    q["stored_production"] = _sql(_total("Production", 'Item, "Year"', primary.format("qcl")), "qcl", "items")
    q["kpi_summary_scope"] = _sql(_kpis(_AREAS, _ITEMS, 1999, None, None), "paired", "countries", "pp")
    q["country_comparison"] = _sql(
        f"""SELECT * FROM (
              SELECT 'Production' AS Element, * FROM ({_total('Production', 'Area, "Year"')})
              UNION ALL SELECT 'Area harvested', * FROM ({_total('Area harvested', 'Area, "Year"')})
              UNION ALL SELECT 'Yield', * FROM ({_YIELD_BY_AREA}))
            WHERE Value IS NOT NULL AND "Year" IN (
              SELECT "Year" FROM crops GROUP BY 1 HAVING count(DISTINCT Area) >= 2)""", "paired"
    )
    q["crop_comparison"] = _sql(
        """SELECT Item, Area, "Year", Unit, Value FROM ny WHERE Element = 'Yield' AND "Year" IN (
             SELECT "Year" FROM ny WHERE Element = 'Yield' GROUP BY 1 HAVING count(DISTINCT Item) >= 2)""", "ny"
    )
    q["missing_items"] = _sql(
        """SELECT Item FROM items WHERE Item NOT IN (
             SELECT Item FROM crops WHERE Element = 'Yield' AND Area = 'NATION_3' AND "Year" = 1998
             AND Value IS NOT NULL)""", "items", "crops"
    )
    q["missing_items_by_domain"] = _sql(
        """SELECT d.Domain, i.Item FROM items i, (VALUES ('TCL'), ('PP')) d(Domain)
           WHERE NOT EXISTS (
             SELECT 1 FROM obs o WHERE o.Domain = d.Domain AND o.Item = i.Item AND o.Area = 'NATION_5'
             AND o.Value IS NOT NULL AND (o.Element = 'Import value' OR o.Months = 'Annual value'))""",
        "items", "obs",
    )
    q["question_intents"] = _sql(_questions(), "paired")
    q["domain_union"] = _sql(f"SELECT {_ALL} FROM obs", "obs")

    # Exports
    q["formula_safe"] = (
        "SELECT doc_id, " + _SAFE.format("t") + " AS text FROM ("
        "SELECT doc_id, substr('=+-@x', CAST(1 + doc_id % 5 AS INTEGER), 1) || text AS t FROM documents)"
    )
    q["formula_safe_cells"] = (
        f"SELECT conv_id, turn, {_SAFE.format('role')} AS role, {_SAFE.format('text')} AS text FROM conversations"
    )
    q["csv_export"] = (
        f"SELECT conv_id, turn, nullif({_SAFE.format('role')}, '') AS role, nullif({_SAFE.format('text')}, '') AS text "
        "FROM conversations"
    )
    q["export_parts"] = _sql(
        """SELECT Domain, part, Domain || '_' || CAST(part AS VARCHAR) AS sheet,
                  least(n - (part - 1) * 1000, 1000) AS n_rows
           FROM (SELECT Domain, n, CAST(unnest(generate_series(1, greatest(1, CAST(ceil(n / 1000.0) AS BIGINT)))) AS INTEGER) AS part
                 FROM (SELECT Domain, count(*) AS n FROM obs GROUP BY 1))""", "obs"
    )
    q["export_sheets"] = _sql(
        """SELECT Domain, Domain || '_' || CAST((place - 1) // 1000 + 1 AS VARCHAR) AS sheet, CAST(1 AS BIGINT) AS n_files,
                  count(*) AS n_rows, count(Value) AS n_values, min(Area) AS first_area, max(Area) AS last_area,
                  min(Value) AS least, max(Value) AS greatest
           FROM (SELECT *, row_number() OVER (PARTITION BY Domain ORDER BY Area NULLS LAST, Item NULLS LAST,
                        Element NULLS LAST, "Year" NULLS LAST, Months NULLS LAST) AS place FROM obs)
           GROUP BY 1, 2""", "obs"
    )
    q["provenance"] = _sql(
        """SELECT *, '1996–1999' AS period, 'NATION_3, NATION_8, NATION_15, NATION_20, NATION_21' AS areas,
                  'ECONOMY, LARGE, PROMO, SMALL' AS items FROM meta""", "meta"
    )
    q["domain_summary"] = _sql("SELECT code, name, updated, source, rows FROM meta", "meta")
    return q
