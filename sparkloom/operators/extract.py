"""Records of source files: symbols, imports, calls, routes, models and query sites.

Python is parsed with its own grammar; other languages by patterns, so their rows carry
fidelity = 'approx'. One file gives many rows in its scan task; nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.paths import language
from sparkloom.plans.storage import dealt

# Fixed values.
HTTP = ("get", "post", "put", "patch", "delete", "head", "options")
AUTH_HINTS = ("login_required", "requires_auth", "jwt_required", "auth_required", "permission_classes", "is_authenticated", "current_user", "get_current_user", "requires_permissions", "authenticated")
MODEL_BASES = {"Base", "Model", "DeclarativeBase", "db.Model", "BaseModel", "models.Model", "SQLModel", "Document", "EmbeddedDocument", "AsyncAttrs", "Table"}
MANAGER = {
    "filter": "select", "get": "select", "all": "select", "first": "select", "last": "select", "values": "select", "values_list": "select", "count": "select", "exists": "select", "select_related": "select",
    "prefetch_related": "select", "annotate": "select", "create": "insert", "bulk_create": "insert", "get_or_create": "insert", "update_or_create": "upsert", "update": "update", "bulk_update": "update", "delete": "delete",
}
SESSION = {
    "query": "select", "execute": "raw", "scalars": "select", "get": "select", "scalar": "select", "add": "insert", "add_all": "insert", "merge": "upsert", "delete": "delete", "commit": "unknown", "refresh": "select",
    "exec": "raw", "get_one": "select",
}
RECEIVERS = ("query", "session", "db", "db_session", "conn", "connection", "client")
STATEMENT = re.compile(r"(?is)^\s*(select|insert|update|delete|create\s+table|alter\s+table|drop\s+table)\b")
WITHIN = re.compile(r"(?i)\b(select|insert\s+into|update|delete\s+from)\b")
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Match)

RECORDS = (
    "record string, name string, kind string, parent string, target string, line int, end_line int, complexity int, level int, "
    "names array<string>, exported boolean, auth boolean, detail string, fidelity string, signature string, doc string, decorated boolean"
)
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def name_of(node: ast.AST | None) -> str:
    """The dotted name that an expression is reached by, or nothing."""
    parts: list[str] = []
    while node is not None:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Name):
            parts.append(node.id)
            break
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        else:
            break
    return ".".join(reversed(parts))


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


class Collector(ast.NodeVisitor):
    """Walks a module once, with the stack of classes and functions it is in."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.stack: list[ast.AST] = []
        self.seen: set[tuple] = set()

    def add(self, record: str, name: str, line: int, **kw) -> None:
        self.rows.append({"record": record, "name": name, "line": line, "fidelity": "exact", "names": [], **kw})

    def owner(self) -> str | None:
        return ".".join(x.name for x in self.stack) or None

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.name, node.lineno, kind="import", level=0, names=[a.asname or a.name.split(".")[0]])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.add("import", node.module or "", node.lineno, kind="import", level=node.level, names=[a.name for a in node.names])

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [name_of(b) for b in node.bases]
        methods = [x.name for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
        self.add("symbol", node.name, node.lineno, kind="class", parent=self.owner(), end_line=node.end_lineno, complexity=1, names=methods, exported=False, detail=",".join(bases), signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), doc=ast.get_docstring(node))
        if MODEL_BASES & {b for b in bases} or MODEL_BASES & {b.split(".")[-1] for b in bases}:
            self.model(node)
        self.below(node)

    def model(self, node: ast.ClassDef) -> None:
        table = None
        fields, related = [], []
        for x in node.body:
            target = x.target if isinstance(x, ast.AnnAssign) else x.targets[0] if isinstance(x, ast.Assign) else None
            if not isinstance(target, ast.Name):
                continue
            if target.id == "__tablename__":
                table = _text(x.value)
            elif isinstance(x.value, ast.Call):
                f = name_of(x.value.func).split(".")[-1]
                if f in ("relationship", "ForeignKey", "OneToOneField", "ManyToManyField", "ReferenceField"):
                    arg = x.value.args[0] if x.value.args else None
                    related.append(_text(arg) or name_of(arg))
                fields.append(target.id)
            elif isinstance(x, ast.AnnAssign):
                fields.append(target.id)
        snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", node.name).lower()
        self.add("model", node.name, node.lineno, target=table or snake + "s", names=fields, detail=",".join(r for r in related if r))

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        branches = sum(isinstance(x, BRANCHES) for x in ast.walk(node))
        kind = "method" if self.stack and isinstance(self.stack[-1], ast.ClassDef) else "function"
        a = node.args
        params = [x.arg for x in (*a.posonlyargs, *a.args)] + [f"*{x.arg}" for x in (a.vararg,) if x] + [x.arg for x in a.kwonlyargs] + [f"**{x.arg}" for x in (a.kwarg,) if x]
        gives = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        signature = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({', '.join(params)}){gives}"[:300]
        self.add("symbol", node.name, node.lineno, kind=kind, parent=self.owner(), end_line=node.end_lineno, complexity=1 + branches, names=params, exported=not node.name.startswith("_"), signature=signature, doc=ast.get_docstring(node), decorated=bool(node.decorator_list))
        self.routes(node)
        self.below(node)

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def routes(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        guards = {name_of(x).lower() for d in (*node.decorator_list, *node.args.defaults, *node.args.kw_defaults) if d is not None for x in ast.walk(d) if isinstance(x, ast.Name | ast.Attribute)}
        auth = any(h in g for g in guards for h in AUTH_HINTS)
        for d in node.decorator_list:
            if not isinstance(d, ast.Call) or not isinstance(d.func, ast.Attribute):
                continue
            verb, path = d.func.attr, _text(d.args[0]) if d.args else next((_text(k.value) for k in d.keywords if k.arg in ("path", "rule")), None)
            if path is None:
                continue
            if verb in HTTP:
                methods = [verb.upper()]
            elif verb in ("websocket", "websocket_route"):
                methods = ["WS"]
            elif verb in ("route", "api_route"):
                given = next((k.value for k in d.keywords if k.arg == "methods"), None)
                methods = [_text(e).upper() for e in getattr(given, "elts", []) if _text(e)] or ["GET"]
            else:
                continue
            framework = "Flask" if verb == "route" else "FastAPI"
            self.add("route", path, node.lineno, kind="/".join(methods), parent=node.name, target=name_of(d.func.value), auth=auth or None, detail=framework)

    def visit_Assign(self, node: ast.Assign) -> None:
        name = node.targets[0].id if isinstance(node.targets[0], ast.Name) else None
        if name and not self.stack and name.isupper():
            self.add("symbol", name, node.lineno, kind="constant", end_line=node.end_lineno, complexity=1, exported=not name.startswith("_"))
        if name and isinstance(node.value, ast.Call) and name_of(node.value.func).split(".")[-1] in ("APIRouter", "Blueprint", "FastAPI", "Flask"):
            prefix = next((_text(k.value) for k in node.value.keywords if k.arg in ("prefix", "url_prefix")), None)
            self.add("router", name, node.lineno, target=prefix or "")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        full = name_of(node.func)
        if full and (full, node.lineno) not in self.seen:
            self.seen.add((full, node.lineno))
            head, _, last = full.rpartition(".")
            self.add("call", last, node.lineno, parent=self.owner(), target=full, detail=head or None)
            if last in ("include_router", "register_blueprint") and node.args:
                prefix = next((_text(k.value) for k in node.keywords if k.arg in ("prefix", "url_prefix")), None)
                self.add("mount", name_of(node.args[0]), node.lineno, parent=head, target=prefix or "")
            self.queries(node, head.split("."), last)
        self.generic_visit(node)

    def queries(self, node: ast.Call, head: list[str], last: str) -> None:
        """Calls on managers and sessions, and statements in text(); the library is the record's target."""
        first = node.args[0] if node.args else None
        literal = _text(first) or ""
        if "objects" in head:
            if last in MANAGER:
                self.add("query", ".".join(head[: head.index("objects")][-1:]), node.lineno, kind=MANAGER[last], parent=self.owner(), target="Django ORM")
        elif (head[-1] in RECEIVERS or head[-1].endswith(("_session", "_conn"))) and last in SESSION:
            found = next((_text(x) for x in ast.walk(node) if _text(x)), None)
            self.add("query", name_of(first).split(".")[-1], node.lineno, kind=SESSION[last], parent=self.owner(), target="SQLAlchemy", detail=found)
        if last in ("text", "sql") and WITHIN.search(literal) and not STATEMENT.match(literal):
            self.statement(literal, node.lineno)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str) and STATEMENT.match(node.value):
            self.statement(node.value, node.lineno)

    def statement(self, text: str, line: int) -> None:
        kind = re.match(r"\s*(\w+)", text)
        self.add("query", "", line, kind=kind[1].lower() if kind else "unknown", parent=self.owner(), target="raw SQL", detail=text.strip()[:200])

    def below(self, node: ast.AST) -> None:
        self.stack.append(node)
        self.generic_visit(node)
        self.stack.pop()


def _found(text: str) -> list[dict]:
    """python_rows without the columns that a record lacks."""
    c = Collector()
    try:
        c.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError) as e:
        c.rows = []
        c.add("error", type(e).__name__, getattr(e, "lineno", None) or 0)
    return c.rows


def python_rows(text: str) -> list[dict]:
    """Records of a Python module; one 'error' record if it does not parse."""
    return [dict.fromkeys(_NAMES) | r for r in _found(text)]


#: Python files that one task parses, and records that it hands on at once.
PARSED, HANDED = 10_000, 10_000


def python_records(files: DataFrame) -> DataFrame:
    """Rows (path, *RECORDS) of the Python files of files (path, text), which must be cheap to count.

    Files are dealt to tasks by their number: small ones take time, but few bytes.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = {n: kinds[k] for n, k in (x.split() for x in f"path string, {RECORDS}".split(", "))}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], list(types))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for r in _found(text):
                    r["path"] = path
                    rows.append(r)
                if len(rows) >= HANDED:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    some = files.where((language(F.col("path")) == "python") & F.col("text").isNotNull() & (F.length("text") > 0))
    return dealt(some.select("path", "text"), files.count(), PARSED, "path").mapInArrow(parse, f"path string, {RECORDS}")


#: Patterns of other languages: (record, kind, pattern); group 1 is the name. Of routes, queries and mounts group 1 is the
#: method, the operation or the prefix, and group 2 the path, the model or what is mounted.
PATTERNS = {
    "javascript": (
        ("import", "import", r"""(?m)^\s*import\s+(?:[^'";]*?\sfrom\s+)?['"]([^'"]+)['"]"""),
        ("import", "reexport", r"""(?m)^\s*export\s+[^'";]*?\sfrom\s+['"]([^'"]+)['"]"""),
        ("import", "require", r"""\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""),
        ("symbol", "function", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
        ("symbol", "class", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
        ("symbol", "function", r"(?m)^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
        ("symbol", "type", r"(?m)^\s*(?:export\s+)?(?:interface|type|enum)\s+([A-Za-z_$][\w$]*)"),
        ("symbol", "method", r"(?m)^\s+(?:(?:public|private|protected|static|override|async|get|set)\s+)*\*?(?!(?:if|for|while|switch|catch|with|function|return)\b)(#?[A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::\s*[^={;]+)?\{"),
        ("symbol", "state", r"(?m)^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:\w+\.)*(?:createContext|createSlice|createApi|createAsyncThunk)\b"),
        ("symbol", "router", r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:new\s+)?(?:(?:\w+\.)*Router|express)\("),
        ("symbol", "constant", r"""(?m)^(?:export\s+)?const\s+([A-Z][\w]*)\s*(?::[^=]+)?=\s*(?=[\[{"'`\d]|true\b|false\b|null\b)"""),
        ("route", "express", r"""\b(?:app|router|server|fastify)\.(get|post|put|patch|delete|all)\(\s*['"`]([^'"`]+)['"`]"""),
        ("route", "nest", r"""(?m)^\s*@(Get|Post|Put|Patch|Delete|All)\(\s*['"`]?([^'"`)]*)['"`]?\s*\)"""),
        ("mount", "express", r"""\b(?:app|router)\.use\(\s*['"`]([^'"`]+)['"`]\s*,\s*([\w.]+)"""),
        ("mount", "nest", r"""@Controller\(\s*['"`]([^'"`]*)['"`]\s*\)\s*(?:export\s+)?class\s+(\w+)"""),
        ("model", "typeorm", r"""@Entity\([^)]*\)\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"""),
        ("model", "mongoose", r"""\bmongoose\.model(?:<[^>]*>)?\(\s*['"`](\w+)"""),
        ("model", "sequelize", r"""\bsequelize\.define\(\s*['"`](\w+)"""),
        ("query", "prisma", r"""\bprisma\.(?=\w+\.(\w+)\()(\w+)"""),
    ),
    "go": (
        ("import", "import", r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+/[^"\s]+|[a-z]+)"\s*$"""),
        ("symbol", "function", r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
        ("symbol", "class", r"(?m)^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)"),
        ("route", "gin", r"""\b\w+\.(GET|POST|PUT|PATCH|DELETE)\(\s*"([^"]+)\""""),
    ),
    "java": (
        ("import", "import", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"),
        ("symbol", "class", r"(?m)^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"),
        ("route", "spring", r"""@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?"([^"]+)\""""),
    ),
    "ruby": (("import", "require", r"""(?m)^\s*require\s+['"]([^'"]+)"""), ("import", "require_relative", r"""(?m)^\s*require_relative\s+['"]([^'"]+)"""), ("symbol", "function", r"(?m)^\s*def\s+(?:self\.)?([a-z_]\w*[?!]?)"), ("symbol", "class", r"(?m)^\s*(?:class|module)\s+([A-Z]\w*)"), ("route", "rails", r"""(?m)^\s*(get|post|put|patch|delete)\s+['"]([^'"]+)""")),
    "php": (("import", "import", r"(?m)^\s*use\s+([\w\\]+)"), ("symbol", "function", r"(?m)\bfunction\s+([A-Za-z_]\w*)"), ("symbol", "class", r"(?m)^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+([A-Za-z_]\w*)"), ("route", "laravel", r"""Route::(get|post|put|patch|delete)\(\s*['"]([^'"]+)""")),
    "rust": (("import", "import", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"), ("symbol", "function", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([a-z_]\w*)"), ("symbol", "class", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Z]\w*)")),
    "c": (("import", "include", r"""(?m)^\s*#\s*include\s+[<"]([^>"]+)"""), ("symbol", "function", r"(?m)^[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;{)]*\)\s*\{"), ("symbol", "class", r"(?m)^\s*(?:typedef\s+)?(?:struct|class)\s+([A-Za-z_]\w*)\s*[{:]")),
    "csharp": (("import", "using", r"(?m)^\s*using\s+([\w.]+)\s*;"), ("symbol", "class", r"(?m)^\s*(?:public\s+|internal\s+|abstract\s+|sealed\s+|static\s+)*(?:class|interface|record|struct)\s+([A-Za-z_]\w*)")),
}
SAME = {"typescript": "javascript", "cpp": "c"}


def pattern_records(files: DataFrame) -> DataFrame:
    """Rows (path, record, kind, name, detail, fidelity) of other languages, by column functions only.

    detail: the method of a route, the operation of a query, the prefix of a mount.
    """
    kind = language(F.col("path"))
    for a, b in SAME.items():
        kind = F.when(kind == a, b).otherwise(kind)
    found: Column = F.array().cast("array<struct<record: string, kind: string, name: string, detail: string>>")
    for lang, rules in PATTERNS.items():
        each = [_tagged(*rule) for rule in rules]
        found = F.when(F.col("lang") == lang, F.concat(*each)).otherwise(found)
    rows = files.withColumn("lang", kind).where(F.col("lang").isin(*PATTERNS) & F.col("text").isNotNull())
    return rows.select("path", F.explode(found).alias("r")).select("path", "r.record", "r.kind", "r.name", "r.detail", F.lit("approx").alias("fidelity"))


def _tagged(record: str, kind: str, pattern: str) -> Column:
    part = lambda k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    row = lambda name, detail: F.struct(F.lit(record).alias("record"), F.lit(kind).alias("kind"), name.alias("name"), detail.cast("string").alias("detail"))
    if record in ("route", "query", "mount"):
        return F.zip_with(part(2), part(1), lambda x, y: row(x, F.upper(y) if record == "route" else y))
    return F.transform(part(1), lambda x: row(x, F.lit(None)))


#: What part of an imported module's name tells of which framework.
PYTHON_HINTS = {
    "fastapi": "FastAPI", "flask": "Flask", "django": "Django", "rest_framework": "Django REST Framework", "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic", "celery": "Celery", "starlette": "Starlette",
    "tortoise": "Tortoise ORM", "peewee": "Peewee", "mongoengine": "MongoEngine", "boto3": "AWS SDK",
}
JS_HINTS = {
    "next": "Next.js", "react": "React", "express": "Express", "@nestjs": "NestJS", "fastify": "Fastify", "koa": "Koa", "@prisma/client": "Prisma", "prisma": "Prisma", "sequelize": "Sequelize", "typeorm": "TypeORM",
    "mongoose": "Mongoose", "knex": "Knex", "drizzle-orm": "Drizzle ORM", "@trpc/server": "tRPC", "graphql": "GraphQL (Apollo)", "apollo-server": "GraphQL (Apollo)", "@apollo/server": "GraphQL (Apollo)",
    "redux": "Redux", "@reduxjs/toolkit": "Redux", "zustand": "Zustand", "vue": "Vue", "svelte": "Svelte", "axios": "Axios", "jsonwebtoken": "JWT", "bcrypt": "bcrypt", "passport": "Passport", "cors": "CORS",
    "zod": "Zod", "ws": "WebSockets", "socket.io": "Socket.IO", "ioredis": "Redis", "redis": "Redis", "pg": "PostgreSQL (node-postgres)", "mongodb": "MongoDB", "mysql2": "MySQL", "better-sqlite3": "SQLite",
    "@trpc/client": "tRPC", "@tanstack/react-query": "TanStack Query", "tailwind-merge": "Tailwind CSS",
}
OTHER_HINTS = {
    "spring": "Spring Boot", "springframework": "Spring Boot", "gin-gonic": "Gin", "labstack/echo": "Echo", "gorm.io": "GORM", "database/sql": "database/sql", "rails": "Rails", "sinatra": "Sinatra",
    "illuminate": "Laravel", "symfony": "Symfony", "actix": "Actix", "axum": "Axum", "serde": "Serde", "gorm": "GORM", "sqlx": "sqlx", "tokio": "Tokio",
}


def framework_hints(imports: DataFrame) -> DataFrame:
    """Distinct (path, framework) that imports (path, name) tell of: a marker within the name, or at its head in JavaScript.

    The markers are a fixed list, so each import is tried against them in its own row.
    """
    name, lang = F.lower("name"), language(F.col("path"))
    within = lambda hints: F.array_compact(F.array(*[F.when(name.contains(k), F.lit(v)) for k, v in hints.items()]))
    head = F.array_compact(F.array(*[F.when((name == k) | name.startswith(k + "/"), F.lit(v)) for k, v in JS_HINTS.items()]))
    found = F.when(lang == "python", within(PYTHON_HINTS)).when(lang.isin("javascript", "typescript", "jsx", "tsx"), head).otherwise(within(OTHER_HINTS))
    return imports.where("name is not null").select("path", F.explode(found).alias("framework")).distinct()


URLS = r"""\b(?:path|re_path|url)\(\s*r?['"]([^'"]*)['"]\s*,\s*(include\(\s*)?['"]?([\w.]+)"""


def django_routes(files: DataFrame) -> DataFrame:
    """Rows (path, method, local, handler, included) of the URL tables of Django: files named urls.py, and those of a urls folder.

    A pattern that includes another table has that table's module as included and no handler; anchors of
    regular expressions are taken off. Methods are not known there, so they are ANY.
    """
    tables = files.where(F.col("path").rlike(r"(^|/)urls\.py$|(^|/)urls/[^/]+\.py$") & F.col("text").isNotNull())
    part = lambda k: F.regexp_extract_all("text", F.lit(URLS), F.lit(k))
    rows = tables.select("path", F.explode(F.arrays_zip(part(1).alias("local"), part(2).alias("inc"), part(3).alias("name"))).alias("r"))
    far = F.col("r.inc") != ""
    return rows.select("path", F.lit("ANY").alias("method"), F.concat(F.lit("/"), F.regexp_replace(F.col("r.local"), r"^[\^/]+|\$$", "")).alias("local"), F.when(~far, F.col("r.name")).alias("handler"), F.when(far, F.col("r.name")).alias("included"))


TABLES = r"""(?i)(?:\bop\.create_table|\bcreateTable|\bcreate_table)\(?\s*['":]+(\w+)|\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?["`\[]?(\w+)"""
OPERATIONS = r"\bop\.\w+|CREATE TABLE|ALTER TABLE|createTable|addColumn"


def migrations(files: DataFrame) -> DataFrame:
    """Rows (path, table, operations): the tables that files below a migrations folder create, with each file's number of operations."""
    some = files.where(F.lower("path").rlike(r"(^|/)(migrations?|alembic/versions|db/migrate)/") & F.col("text").isNotNull())
    both = F.zip_with(F.regexp_extract_all("text", F.lit(TABLES), F.lit(1)), F.regexp_extract_all("text", F.lit(TABLES), F.lit(2)), lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y))
    return some.select("path", F.explode(F.array_distinct(both)).alias("table"), F.regexp_count("text", F.lit(OPERATIONS)).cast("long").alias("operations"))
