"""Column functions on paths and addresses: names, languages, layers, roles, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "rb": "ruby", "php": "php", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp",
    "md": "markdown", "rst": "restructuredtext", "txt": "text", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "html": "html", "css": "css", "sql": "sql", "sh": "shell",
}
DOC_LANGUAGES = ("markdown", "restructuredtext", "text")
ENTRYPOINTS = ("main", "manage", "wsgi", "asgi", "server", "cli", "__main__", "run", "start", "worker", "celery_app", "bootstrap")
WEAK_ENTRYPOINTS = ("app", "index")
LAYERS = {
    "route": ("routes", "route", "routers", "router", "urls", "api", "endpoints", "controllers", "controller", "handlers", "handler", "views", "view", "pages", "app"),
    "service": ("services", "service", "usecases", "use_cases", "domain", "business", "managers", "manager"),
    "repository": ("repositories", "repository", "repos", "repo", "dao", "crud", "store", "stores", "models", "model", "entities", "entity", "schema", "schemas", "db", "database", "persistence", "migrations"),
    "middleware": ("middleware", "middlewares", "guards", "interceptors", "filters", "security", "auth", "permissions"),
    "ui": ("components", "component", "ui", "widgets", "screens", "layouts", "hooks", "styles", "templates", "static", "assets"),
    "config": ("config", "configs", "settings", "env", "constants", "infra", "infrastructure", "deploy", "deployment", ".github", "docker", "scripts", "ci"),
    "util": ("utils", "util", "helpers", "helper", "lib", "libs", "common", "shared", "core", "tools", "support"),
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    """By extension, or by the names Dockerfile and Makefile; else unknown."""
    name = F.lower(basename(path))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(name.startswith("dockerfile"), "dockerfile").when(name == "makefile", "makefile").otherwise(F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown")))


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|__tests__|specs?|e2e)/|(^|/)(test_[^/]*|conftest[^/]*)$|(_test|\.test|\.spec)\.[^/]*$")


def is_example(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(examples?|samples?|demos?|docs_src|fixtures?)/")


def _plain(part: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(part, r"\."), 1), "[^a-z0-9_]", "")


def layer(path: Column) -> Column:
    """Layer by role, then the file's stem, then the deepest folder that names one."""
    by_word = F.create_map(*[F.lit(x) for k in reversed(LAYERS) for w in LAYERS[k] for x in (w, k)])
    parts = F.filter(F.split(F.lower(path), r"[/\\]"), lambda p: p != "")
    stem = _plain(F.element_at(parts, -1))
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    deepest = F.get(F.filter(F.transform(folders, lambda p: F.try_element_at(by_word, _plain(p))), lambda x: x.isNotNull()), F.lit(0))
    return (
        F.when(F.size(parts) == 0, "other")
        .when(is_test(path), "test")
        .when(language(path).isin(*DOC_LANGUAGES), "docs")
        .when(stem.isin(*ENTRYPOINTS), "entrypoint")
        .otherwise(F.coalesce(F.try_element_at(by_word, stem), deepest, F.when(stem.isin(*WEAK_ENTRYPOINTS), "entrypoint"), F.lit("other")))
    )


def repo_of(address: Column) -> Column:
    """owner/name of a repository address (short, https or ssh form), else null."""
    short = F.regexp_extract(F.btrim(address), r"^(?:https?://[^/]+/|git@[^:]+:)?([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?)(?:\.git)?(?:/(?:tree|blob)/.*)?/?$", 1)
    return F.nullif(short, F.lit(""))


def app_route(path: Column) -> Column:
    """Route of a file below app/ or pages/: folders as they are, [id] as :id, groups and file names left out; else null."""
    inner = F.regexp_extract(path, r"(?:^|/)(?:app|pages)/(.*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, r"\.(?:tsx?|jsx?)$", ""), r"(?:^|/)(?:page|route|index)$", "")
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\[\[?\.\.\.([^\]]+)\]\]?", r"*$1"), r"\[([^\]]+)\]", r":$1"), r"\([^)]*\)/?", "")
    return F.when(path.rlike(r"(?:^|/)(?:app|pages)/.*\.(?:tsx?|jsx?)$"), F.concat(F.lit("/"), named))
