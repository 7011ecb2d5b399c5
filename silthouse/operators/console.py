"""Read-only SQL over registered views, and the helper functions that its users may call."""

from __future__ import annotations

import difflib
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 1000


#: Plan nodes and expressions with plans that a query may have; everything else is refused.
QUERY_NODES = frozenset(
    """Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation
    Offset OneRowRelation Pivot Project Range Sort SubqueryAlias UnresolvedHaving Union UnresolvedInlineTable UnresolvedPivot UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedUnpivot UnresolvedWith Unpivot WithCTE WithWindowDefinition""".split()
)
#: Table functions that a query may name; those of this module are added to them.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode inline stack sh_places_near sh_parcels".split())
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery FunctionTableSubqueryArgumentExpression".split())
#: Functions that call into the machine, read files or change the session.
FORBIDDEN = frozenset("java_method reflect try_reflect read_files input_file_name set_config raise_error".split())


class Refused(ValueError):
    """A statement that isn't a single query."""


def _parts(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _walk(plan, known: frozenset[str], seen: set[str]) -> None:
    """Refuses any node that isn't a query's, in the plan, its named queries and the subqueries of its expressions; adds the tables it reads."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
        names = _parts(plan.name())
        if len(names) > 1 or names[0].lower() not in TABLE_FUNCTIONS:
            raise Refused(f"no table function {'.'.join(names)}")
    elif kind not in QUERY_NODES:
        raise Refused("only queries are allowed")
    if kind == "UnresolvedRelation":
        name = _parts(plan.multipartIdentifier())
        if any(c in part for part in name for c in "/:\\"):
            raise Refused("files are no tables")
        if len(name) > 1 or name[0].lower() not in known:
            seen.add(".".join(name).lower())
    if kind == "UnresolvedWith":
        for named in _parts(plan.cteRelations()):
            _walk(named._2(), known, seen)
            known |= {named._1().lower()}  # a name stands for its query in those after it
    for child in _parts(plan.children()):
        _walk(child, known, seen)
    left = _parts(plan.expressions())
    while left:
        x = left.pop()
        name = x.getClass().getSimpleName()
        if name == "UnresolvedFunction" and any(part.lower() in FORBIDDEN for part in _parts(x.nameParts())):
            raise Refused("functions that call into the machine are not allowed")
        if name in SUBQUERIES:
            _walk(x.plan(), known, seen)
        left += _parts(x.children())


def guarded(spark: SparkSession, sql: str, tables: set[str] | None = None) -> DataFrame:
    """The plan of one SELECT or WITH query. Spark's own parser says what a statement is; nothing but a query over the allowed tables runs."""
    text = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused(f"not one statement: {str(e).splitlines()[0]}") from None
    seen: set[str] = set()
    _walk(plan, frozenset(), seen)
    if tables is not None and seen - {t.lower() for t in tables}:
        raise Refused(f"no table {', '.join(sorted(seen - {t.lower() for t in tables}))}")
    try:
        return spark.sql(text)
    except AnalysisException as e:
        raise Refused(hint(spark, str(e), tables or {t.name for t in spark.catalog.listTables()})) from None
    except ParseException as e:
        raise Refused(str(e).splitlines()[0]) from None


def search_path(path: str) -> list[str]:
    """The schemas of a comma-separated list, which must be plain names in lower case."""
    names = [x.strip() for x in path.split(",") if x.strip()]
    for name in names:
        if not re.fullmatch("[a-z_][a-z0-9_]*", name):
            raise Refused(f"no schema name: {name!r}")
    if not names:
        raise Refused("no schema is allowed")
    return names


def across(spark: SparkSession, sql: str, path: str) -> DataFrame:
    """A guarded query over the schemas of a search path: a bare name is the first schema's table that has it, a name with
    a schema needs that schema on the path, and nothing else is a table, neither views of the session nor other catalogs.

    It is planned in a session of its own, so that names which two callers look up along different paths don't meet.
    """
    schemas = search_path(path)
    seen: set[str] = set()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:
        raise Refused(f"not one statement: {str(e).splitlines()[0]}") from None
    _walk(plan, frozenset(), seen)
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    for name in sorted(seen):
        schema, _, table = name.rpartition(".")
        if schema and schema not in schemas:
            raise Refused(f"no schema {schema}")
        # backquoted names with a point inside are no names of this catalog
        found = [s for s in ([schema] if schema else schemas) if re.fullmatch("[a-z0-9_]+", table) and spark.catalog.tableExists(f"{s}.{table}")]
        if not found:
            raise Refused(f"no table {name}")
        if not schema:
            own.table(f"{found[0]}.{table}").createOrReplaceTempView(table)
    return guarded(own, sql, seen)


def hint(spark: SparkSession, message: str, tables: set[str]) -> str:
    """The first line of an error, with the known column that is closest to the unknown one."""
    found = re.search(r"name `([^`]+)`", message)
    known = sorted({c.name for t in tables for c in spark.catalog.listColumns(t)} | set(tables))
    near = difflib.get_close_matches(found[1], known, 1) if found else []
    return message.splitlines()[0] + (f" Did you mean {near[0]}?" if near else "")


def run(spark: SparkSession, sql: str, tables: set[str] | None = None, most: int = MOST_ROWS) -> tuple[list, bool]:
    """At most so many rows of a guarded query, and whether there are more."""
    rows = guarded(spark, sql, tables).limit(most + 1).collect()
    return rows[:most], len(rows) > most


#: Helper functions as SQL, so that they are part of a query's plan.
FUNCTIONS = {
    "sh_norm(s STRING)": ("STRING", "lower(regexp_replace(s, '[^0-9A-Za-zא-ת]+', ''))"),
    "sh_house_num(s STRING)": ("INT", "try_cast(nullif(coalesce(nullif(regexp_extract(s, '^\\\\s*([0-9]+)', 1), ''), regexp_extract(s, '([0-9]+)[^0-9]*$', 1)), '') AS INT)"),
    "sh_parcel_key(b BIGINT, s BIGINT, p BIGINT)": ("STRING", "CASE WHEN b IS NOT NULL AND p IS NOT NULL THEN concat_ws('-', b, coalesce(s, 0), p) END"),
    "sh_distance_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE)": ("DOUBLE", "2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the helper functions for a session; their signatures."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


#: Table functions over the views `places` (id, lon, lat) and `parcels` (parcel_key, block, parcel).
TABLES = {
    "sh_places_near(x DOUBLE, y DOUBLE, metres DOUBLE)": (
        "places",
        "id STRING, lon DOUBLE, lat DOUBLE, distance_m DOUBLE",
        "SELECT * FROM (SELECT CAST(id AS STRING), lon, lat, sh_distance_m(lon, lat, x, y) AS distance_m FROM places WHERE lat BETWEEN y - metres / 111000 AND y + metres / 111000) WHERE distance_m <= metres",
    ),
    "sh_parcels(b BIGINT, p BIGINT)": ("parcels", "parcel_key STRING, block BIGINT, parcel BIGINT", "SELECT parcel_key, block, parcel FROM parcels WHERE block = b AND parcel = p"),
}


def register_tables(spark: SparkSession) -> list[str]:
    """Creates the scalar helpers and the table functions whose view the session has; the signatures of the latter.

    They are SQL, so that their filters reach the view's scan. A query may call them without being allowed the view.
    """
    register(spark)
    made = []
    for signature, (view, columns, body) in TABLES.items():
        if spark.catalog.tableExists(view):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({columns}) RETURN {body}")
            made.append(signature)
    return made
