"""A code base written from the driver's tables: what the code operators are run on at any size.

Parts are modules with a model and a function, which import and call those of two other parts (taken from
their line items); suppliers have a router with a route for each of their parts, a script, a Java class, C
files and a job; nations have an application that mounts their suppliers' routers, a URL table and a
script; small parts have tests, and every fifty parts a migration. All texts are made by column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.storage import dealt, staged
from sparkloom.sources.proxy import table

#: Folder of a part's module, by its key modulo four.
FOLDERS = ("services", "repositories", "utils", "handlers")


def _text(pattern: str, **parts: Column) -> Column:
    """pattern with {name} replaced by the columns of that name; {{ and }} are braces."""
    pieces, at = [], 0
    for literal, name in _split(pattern):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(parts[name].cast("string"))
    return F.concat(*pieces)


def _split(pattern: str) -> list[tuple[str, str | None]]:
    import string

    return [(literal, name) for literal, name, *_ in string.Formatter().parse(pattern)]


def _folder(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (F.pmod(key, F.lit(4)) + 1).cast("int"))


def _each(items: Column, pattern: str) -> Column:
    """pattern for each key of items, {j} the key and {f} the folder of its part, one after another."""
    return F.array_join(F.transform(items, lambda j: _text(pattern, j=j, f=_folder(j))), "")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """key, size, deps: the sorted keys of the parts that a part imports, from its first and last supplier."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    n = p.count()
    ends = li.groupBy(F.col("l_partkey").alias("key")).agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"))
    named = F.array_sort(F.array_distinct(F.array((F.col("low") * 20) % n, (F.col("high") * 20 + 1) % n)))
    rows = p.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")).join(ends, "key", "left")
    return rows.select("key", "size", F.coalesce(F.filter(named, lambda j: j != F.col("key")), F.array().cast("array<bigint>")).alias("deps"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Rows (path, text, size, reason) as corpus.read_tree gives them."""
    p, s, nations = staged(parts(spark, d), "parts"), table(spark, d, "supplier"), table(spark, d, "nation")
    ns = s.count()
    p = dealt(p, p.count(), 20_000, "key")
    i, f, key = F.col("key"), _folder(F.col("key")), F.col("s_suppkey")
    near = F.when(F.size("deps") > 0, _text("    near = relationship('Part{j}')\n", j=F.get("deps", F.lit(0)))).otherwise("")
    module = F.concat(
        _text('"""Part {i}."""\nimport json\n', i=i), _each(F.col("deps"), "from {f}.part_{j} import run_{j}\n"), _text("\nclass Part{i}(Base):\n    __tablename__ = 'part_{i}'\n    id = Column(Integer)\n", i=i), near,
        _text("\n\ndef run_{i}(x):\n    if x:\n        json.dumps(x)\n", i=i), _each(F.col("deps"), "        run_{j}(x)\n"), _text("    return session.query(Part{i})\n", i=i),
    )
    rows = [p.select(_text("{f}/part_{i}.py", f=f, i=i).alias("path"), module.alias("text"))]
    rows.append(p.where("size <= 10").select(_text("tests/test_part_{i}.py", i=i).alias("path"), _text("from {f}.part_{i} import run_{i}\n\n\ndef test_run_{i}():\n    run_{i}(1)\n", f=f, i=i).alias("text")))
    creates = F.array_join(F.transform(F.array_sort(F.collect_list("key")), lambda j: F.concat(F.when(j % 2 == 0, _text("    op.create_table('part_{j}')\n", j=j)).otherwise(""), F.when(j % 50 == 0, _text("    op.create_table('audit_{j}')\n", j=j)).otherwise(""))), "")
    rows.append(p.groupBy(F.floor(i / 50).alias("q")).agg(creates.alias("ops")).select(_text("alembic/versions/v{q}_parts.py", q=F.col("q")).alias("path"), F.concat(F.lit("def upgrade():\n"), "ops", F.lit("    return 1\n")).alias("text")))

    of = p.groupBy((i % ns).alias("s_suppkey")).agg(F.array_sort(F.collect_list("key")).alias("mine"))  # as many as there are parts to a supplier
    s = staged(s.select("s_suppkey", "s_nationkey", "s_name").join(of, "s_suppkey", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<bigint>"))), "suppliers")
    s = dealt(s, ns, 20_000, "s_suppkey")
    verb = lambda j: F.when(j % 2 == 0, "get").otherwise("post")
    guard = lambda j: F.when(j % 3 == 0, ", me=Depends(current_user)").otherwise("")
    routes = F.array_join(F.transform("mine", lambda j: _text("\n\n@router.{v}('/p{j}')\ndef read_{j}(id{g}):\n    return run_{j}(id)\n", j=j, v=verb(j), g=guard(j))), "")
    api = F.concat(F.lit("from fastapi import APIRouter, Depends\n"), _each(F.col("mine"), "from {f}.part_{j} import run_{j}\n"), _text("\nrouter = APIRouter(prefix='/s{s}')\n", s=key), routes)
    after, nation = (key + 1) % ns, F.col("s_nationkey")
    script = _text("import {{ api{n} }} from './nation_{n}'\nimport axios from 'axios'\n// TODO: check {w}\nexport function load{s}(id) {{\n  return axios.get(id)\n}}\napp.get('/web/s{s}', load{s})\n", n=nation, s=key, w=F.col("s_name"))
    java = _text('import java.util.List;\nimport com.shop.S{t};\n\npublic class S{s} {{\n  @GetMapping("/java/s{s}")\n  public List<String> all() {{ return null; }}\n}}\n', s=key, t=after)
    c = _text('#include "inc/s{t}.h"\n#include <stdio.h>\n\nint go_{s}(void) {{\n  return {s};\n}}\n', s=key, t=after)
    job = _text("from celery import shared_task\n\n\n@shared_task\ndef send_{s}(to):\n    return to\n\n\ndef task_clean_{s}():\n    return {s}\n\n\ndef other_{s}():\n    return 2\n", s=key)
    for at, text in (("api/supplier_{s}.py", api), ("web/src/supplier_{s}.ts", script), ("j/com/shop/S{s}.java", java), ("c/s{s}.c", c), ("inc/s{s}.h", _text("int go_{s}(void);\n", s=key)), ("jobs/supplier_{s}.py", job)):
        rows.append(s.select(_text(at, s=key).alias("path"), text.alias("text")))

    own = s.groupBy(nation.alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("mine"))
    nations = nations.join(own, "n_nationkey", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<bigint>")))
    n = F.col("n_nationkey")
    app = F.concat(F.lit("from fastapi import FastAPI\n"), _each(F.col("mine"), "from api import supplier_{j}\n"), F.lit("\napp = FastAPI()\n"), F.array_join(F.transform("mine", lambda j: _text("app.include_router(supplier_{j}.router, prefix='/n{n}')\n", j=j, n=n)), ""))
    urls = F.concat(F.lit("from django.urls import include, path\n\nurlpatterns = [\n"), _each(F.col("mine"), "    path('s{j}/', views.s{j}),\n"), _text("    path('more/', include('shop.nation_{m}.urls')),\n]\n", m=(n + 1) % 25))
    for at, text in (("app/nation_{n}.py", app), ("shop/nation_{n}/urls.py", urls), ("web/src/nation_{n}.ts", _text("export const api{n} = async () => {n}\n", n=n))):
        rows.append(nations.select(_text(at, n=n).alias("path"), text.alias("text")))
    region = s.join(nations.select(n.alias("s_nationkey"), "n_regionkey"), "s_nationkey").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("all"))
    rows.append(region.select(_text("svc/r{r}/requirements.txt", r=F.col("n_regionkey")).alias("path"), _each(F.col("all"), "lib{j}=={j}.0\n").alias("text")))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out.select("path", "text", F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("string").alias("reason"))


#: The same code base for the checking SQL: its facts, not its texts. k: a part's imports, r: 1 if it has any.
SQL = """n AS (SELECT count(*) AS n FROM part), nsup AS (SELECT count(*) AS ns FROM supplier),
ends AS (SELECT l_partkey AS i, (min(l_suppkey) * 20) % any_value(n) AS a, (max(l_suppkey) * 20 + 1) % any_value(n) AS b FROM lineitem, n GROUP BY 1),
deps AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) AS place FROM (SELECT i, a AS j FROM ends UNION SELECT i, b FROM ends) WHERE i <> j),
parts AS (SELECT p_partkey AS i, p_size, count(j) AS k, least(count(j), 1) AS r, min(j) AS first FROM part LEFT JOIN deps ON i = p_partkey GROUP BY 1, 2),
mods AS (SELECT i, p_size, k, r, first, CASE i % 4 WHEN 0 THEN 'services' WHEN 1 THEN 'repositories' WHEN 2 THEN 'utils' ELSE 'handlers' END AS folder, 9 + k + r AS f FROM parts),
m AS (SELECT *, folder || '.part_' || i AS module, folder || '/part_' || i || '.py' AS path, 'run_' || i AS run FROM mods),
routes AS (SELECT s_suppkey AS s, s_nationkey AS nation, i, 'api/supplier_' || s_suppkey || '.py' AS path, module, m.path AS part, run, count(*) OVER (PARTITION BY s_suppkey) AS c, row_number() OVER (PARTITION BY s_suppkey ORDER BY i) - 1 AS q
  FROM supplier, nsup JOIN m ON i % ns = s_suppkey),
read AS (SELECT *, 'read_' || i AS handler, 7 + c + 5 * q AS line FROM routes),
apis AS (SELECT s_suppkey AS s, s_nationkey AS nation, 'api/supplier_' || s_suppkey || '.py' AS path, (SELECT count(*) FROM m, nsup WHERE m.i % ns = s_suppkey) AS c FROM supplier),
apps AS (SELECT n_nationkey AS nation, 'app/nation_' || n_nationkey || '.py' AS path, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS c FROM nation),
mounts AS (SELECT s_nationkey AS nation, s_suppkey AS s, 'app/nation_' || s_nationkey || '.py' AS path, count(*) OVER (PARTITION BY s_nationkey) AS c, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS q FROM supplier),
tests AS (SELECT *, 'tests/test_part_' || i || '.py' AS test FROM m WHERE p_size <= 10),
moves AS (SELECT i // 50 AS q, 'alembic/versions/v' || (i // 50) || '_parts.py' AS path, count(*) FILTER (i % 2 = 0) + count(*) FILTER (i % 50 = 0) AS ops FROM m GROUP BY 1)"""
