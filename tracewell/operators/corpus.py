"""File corpora: scan, classify, read lines, search, and detect stacks, entry points and commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.ids import _col, digest_id
from tracewell.functions.text import first_match_line, line_count
from tracewell.functions.redact import redact_literals, redact_source
from tracewell.operators.skew import prefix_sums, top_n

# Source languages by extension, ignored folders, sanitising lists and header markers.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp",
    ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h++": "cpp",
}
IGNORED_DIRECTORIES = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", "venv", ".venv", ".goenv", "env",
    "dist", "build", "out", "target", "vendor", "third_party", ".idea", ".vscode", ".next", ".nuxt", "coverage", "bin", "obj",
    "Pods", ".tox",
)
NOISE_DIRECTORIES = (".git", "node_modules", "__pycache__", "venv", ".venv", ".goenv", "dist", "build", ".idea", ".vscode")
SENSITIVE_NAMES = ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials.json")
FORBIDDEN_EXTENSIONS = (".exe", ".dll", ".so", ".dmg", ".iso", ".bin", ".zip", ".tar", ".gz")
GENERATED_SUFFIXES = (".min.js", ".min.ts", ".bundle.js", ".d.ts")
CPP_SIBLINGS = (".cpp", ".cc", ".cxx", ".c++")
CPP_MARKERS = (
    "namespace ", "class ", "template<", "template <", "public:", "private:", "protected:", "::", "std::", "virtual ", "operator", "nullptr",
)
FRAMEWORK_RULES = (
    ("FastAPI", (".py",), r"\bFastAPI\s*\("),
    ("Flask", (".py",), r"\bFlask\s*\("),
    ("Django", (".py",), r"\bDJANGO_SETTINGS_MODULE\b|\burlpatterns\s*="),
    ("Spring Boot", (".java", ".kt", ".kts"), r"@SpringBootApplication\b"),
    ("Express", (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"), r"\bexpress\s*\(\s*\)"),
    ("NestJS", (".js", ".ts"), r"@Module\s*\(|NestFactory\.create"),
)
PACKAGE_MANAGER_BY_NAME = {
    "package.json": "npm", "requirements.txt": "pip", "pyproject.toml": "pip", "setup.py": "pip", "setup.cfg": "pip",
    "poetry.lock": "Poetry", "uv.lock": "uv", "pnpm-lock.yaml": "pnpm", "yarn.lock": "Yarn", "pom.xml": "Maven",
    "build.gradle": "Gradle", "build.gradle.kts": "Gradle", "go.mod": "Go Modules", "cargo.toml": "Cargo",
}
# kind, default name, framework, extensions, pattern, group that names the entry point
ENTRYPOINT_RULES = (
    ("web_app", "FastAPI application", "FastAPI", (".py",), r"(?m)^(\w+)\s*=\s*FastAPI\s*\("),
    ("web_app", "Flask application", "Flask", (".py",), r"(?m)^(\w+)\s*=\s*Flask\s*\("),
    ("python_main", "Python module entry", None, (".py",), r"if\s+__name__\s*==\s*['\"]__main__['\"]\s*:"),
    ("java_main", "Java main", None, (".java",), r"public\s+static\s+void\s+main\s*\("),
    ("spring_app", "Spring Boot application", "Spring Boot", (".java", ".kt", ".kts"), r"@SpringBootApplication\b"),
    ("go_main", "Go main", None, (".go",), r"(?m)^\s*func\s+main\s*\(\s*\)"),
    ("rust_main", "Rust main", None, (".rs",), r"(?m)^\s*fn\s+main\s*\(\s*\)"),
)
PACKAGE_FRAMEWORKS = {
    "vue": "Vue", "react": "React", "next": "Next.js", "nuxt": "Nuxt", "vite": "Vite", "express": "Express", "@nestjs/core": "NestJS",
}


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def folder_names(path: Column | str) -> Column:
    parts = F.split(_col(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; a leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def language_of(ext: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair]), ext)


def scan_corpus(
    files: DataFrame, ignored: Sequence[str] = IGNORED_DIRECTORIES, max_bytes: int = 1024 * 1024
) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): source files by extension, outside ignored and dot folders, not generated.

    ``files``: path, size (null where metadata is unavailable) and optionally is_link. Oversize and
    unreadable files go to ``skipped`` with a reason; everything else is pruned.
    """
    folders = folder_names("path")
    name = base_name("path")
    pruned = F.exists(folders, lambda d: d.isin(*ignored) | d.startswith("."))
    generated = F.lit(False)
    for suffix in GENERATED_SUFFIXES:
        generated = generated | name.endswith(suffix)
    links = F.col("is_link") if "is_link" in files.columns else F.lit(False)
    source = files.withColumn("language", language_of(extension("path"))).filter(
        ~pruned & ~generated & ~links & F.col("language").isNotNull()
    )
    reason = F.when(F.col("size").isNull(), "metadata_unavailable").when(F.col("size") > max_bytes, "file_too_large")
    marked = source.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def detect_language(files: DataFrame, head_chars: int | None = None) -> DataFrame:
    """``files`` (path, text) with ``language``; ``.h`` follows its sibling, then its content.

    ``head_chars`` limits how much of a header is read; by default all of it.
    """
    ext = extension("path")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    work = files.withColumn("_ext", ext).withColumn("_stem", stem)
    siblings = (
        work.filter(F.col("_ext").isin(".c", *CPP_SIBLINGS))
        .groupBy("_stem").agg(F.max(F.when(F.col("_ext") == ".c", 1).otherwise(2)).alias("_rank"))
    )
    head = F.coalesce(F.col("text"), F.lit(""))
    if head_chars is not None:
        head = F.substring(head, 1, head_chars)
    marked = F.lit(False)
    for marker in CPP_MARKERS:
        marked = marked | F.contains(head, F.lit(marker))
    header = F.col("_ext") == ".h"
    language = (
        F.when(header & (F.col("_rank") == 2), "cpp").when(header & (F.col("_rank") == 1), "c")
        .when(header & marked, "cpp").otherwise(language_of(F.col("_ext")))
    )
    return work.join(siblings, "_stem", "left").withColumn("language", language).drop("_ext", "_stem", "_rank")


def sanitize_reason(max_file_bytes: int = 5 * 1024 * 1024) -> Column:
    """Why an entry (path, size, is_link) is removed; null for a kept one. The first reason wins."""
    name = F.lower(base_name("path"))
    noisy = F.exists(folder_names("path"), lambda d: F.lower(d).isin(*NOISE_DIRECTORIES))
    sensitive = (name == ".env") | name.startswith(".env.") | name.isin(*SENSITIVE_NAMES)
    return (
        F.when(noisy, "noise_directory").when(F.col("is_link"), "link").when(sensitive, "sensitive")
        .when(extension("path").isin(*FORBIDDEN_EXTENSIONS), "forbidden").when(F.col("size") > max_file_bytes, "oversized")
    )


def sanitize_corpus(
    files: DataFrame, max_files: int = 20_000, max_total_bytes: int = 512 * 1024 * 1024, max_file_bytes: int = 5 * 1024 * 1024,
    per: Sequence[str] = (),
) -> DataFrame:
    """Counters of the clean-up, one row per ``per`` key; ``within_policy`` is false beyond the limits."""
    counted = files.withColumn("reason", F.coalesce(sanitize_reason(max_file_bytes), F.lit("kept")))
    scanned = F.col("reason") != "noise_directory"
    sized = scanned & (F.col("reason") != "link")
    how_many = lambda reason: F.count_if(F.col("reason") == reason)
    return counted.groupBy(*per).agg(
        F.count_if(scanned).alias("scanned_files"),
        F.count_if(scanned & (F.col("reason") != "kept")).alias("filtered_out_files"),
        how_many("sensitive").alias("removed_sensitive_files"), how_many("forbidden").alias("removed_forbidden_files"),
        how_many("oversized").alias("removed_oversized_files"), how_many("link").alias("removed_links"),
        how_many("noise_directory").alias("removed_noise_entries"),
        F.coalesce(F.sum(F.when(sized, F.col("size"))), F.lit(0)).alias("total_bytes"),
    ).withColumn("within_policy", (F.col("scanned_files") <= max_files) & (F.col("total_bytes") <= max_total_bytes))


def audit_archive_entries(
    entries: DataFrame, archive: str = "archive", max_ratio: int = 200, max_total: int = 512 * 1024 * 1024, block_size: int = 4096
) -> DataFrame:
    """Verdict per archive entry (archive, idx, name, size, compressed, mode), in entry order."""
    name = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    parts = F.split(name, "/")
    unsafe = (
        (name == "") | F.contains(name, F.lit("\0")) | name.startswith("/") | F.array_contains(parts, "..")
        | F.exists(parts, lambda p: F.contains(p, F.lit(":")))
    )
    kind = F.col("mode").bitwiseAND(0o170000)
    special = ~kind.isin(0, 0o100000, 0o040000, 0o120000)
    link = kind == 0o120000
    ratio = F.col("size") / F.greatest(F.col("compressed"), F.lit(1))
    work = entries.withColumn(
        "verdict", F.when(unsafe, "unsafe_path").when(special, "special_file").when(ratio > max_ratio, "compression_ratio").when(link, "link_skipped")
    )
    extracted = F.when(F.col("verdict").isNull(), F.col("size")).otherwise(0)
    summed = prefix_sums(work, [archive], F.floor(F.col("idx") / block_size), ["idx"], {"extracted_bytes": extracted})
    return summed.withColumn(
        "verdict", F.coalesce(F.when(F.col("verdict").isNull() & (F.col("extracted_bytes") > max_total), "total_size"), F.col("verdict"), F.lit("ok"))
    )


def explode_lines(files: DataFrame, *keep: str, probe_bytes: int | None = None) -> DataFrame:
    """Numbered lines of ``files`` (path, content); binary and non-UTF-8 content is skipped.

    Lines end at LF, CRLF or CR; a final line end does not start another line. A zero byte makes
    content binary, wherever it stands or within the first ``probe_bytes``.
    """
    probe = F.col("content") if probe_bytes is None else F.substring("content", 1, probe_bytes)
    binary = F.contains(probe, F.lit(bytearray(b"\0")))
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"(\r\n|\n|\r)\z", "")
    readable = files.filter(~binary).withColumn("_text", text).filter("_text is not null and octet_length(content) > 0")
    return readable.select("path", *keep, F.posexplode(F.split("_text", r"\r\n|\n|\r")).alias("_pos", "text")).select(
        "path", *keep, (F.col("_pos") + 1).alias("line"), "text"
    )


def search_literals(lines: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Lines that contain any of one to eight literals, with the indices that matched, in one scan."""
    folded = F.lower("text")
    indices = F.filter(
        F.array(*[F.when(F.contains(folded, F.lit(q.lower())), F.lit(i)) for i, q in enumerate(queries)]), lambda x: x.isNotNull()
    )
    return lines.withColumn("query_indices", indices).filter(F.size("query_indices") > 0)


def hit_previews(hits: DataFrame, max_chars: int = 240) -> DataFrame:
    """Hits (path, line, text, query_indices) with the text replaced by a masked preview and whether it was shortened."""
    masked = redact_source("text", "path")
    shown = hits.withColumn("preview", masked)
    return shown.withColumn("shortened", F.length("preview") > max_chars).withColumn("preview", F.substring("preview", 1, max_chars)).drop("text")


def search_terms_table(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Hits of a table of literal words (idx, word): whole tokens, by an equi join on the folded token."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    tokens = lines.select("path", "line", token.alias("word"))
    return tokens.join(words, "word")


def detect_stack(files: DataFrame) -> DataFrame:
    """Frameworks by extension and pattern, package managers by file name, each with its evidence."""
    ext, name = extension("path"), F.lower(base_name("path"))
    hits = [
        F.when(ext.isin(*exts) & F.col("text").rlike(pattern),
               F.struct(F.lit("framework").alias("kind"), F.lit(label).alias("label"), first_match_line("text", pattern).alias("line")))
        for label, exts, pattern in FRAMEWORK_RULES
    ]
    managers = F.create_map(*[F.lit(x) for pair in PACKAGE_MANAGER_BY_NAME.items() for x in pair])
    manager = F.element_at(managers, name)
    hits.append(F.when(manager.isNotNull(), F.struct(F.lit("package_manager").alias("kind"), manager.alias("label"), F.lit(None).cast("int").alias("line"))))
    return files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("_h")).select("path", "_h.*")


def code_entrypoints(files: DataFrame) -> DataFrame:
    """Entry points found by the fixed detectors, at most one per detector and file."""
    ext = extension("path")
    hits = []
    for kind, label, framework, exts, pattern in ENTRYPOINT_RULES:
        name = F.regexp_extract("text", pattern, 1) if kind == "web_app" else F.lit(label)
        module = F.replace(F.regexp_replace("path", r"...$", ""), F.lit("/"), F.lit("."))
        suggested = F.concat(F.lit("uvicorn "), module, F.lit(":"), name, F.lit(" --reload")) if framework == "FastAPI" else F.lit(None).cast("string")
        hits.append(F.when(ext.isin(*exts) & F.col("text").rlike(pattern), F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), F.lit(framework).cast("string").alias("framework"),
            first_match_line("text", pattern).alias("line"), suggested.alias("suggested_command"))))
    return files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("_h")).select("path", "_h.*")


def line_matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that is anchored to line starts: array of (span, line)."""
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def step(acc, span):
        at = F.instr(F.concat(F.lit("\n"), acc["rest"]), F.concat(F.lit("\n"), span))
        line = acc["line"] + newlines(F.substring(acc["rest"], F.lit(1), at - 1))
        return F.struct(
            F.substring(acc["rest"], at + F.length(span), F.length(acc["rest"])).alias("rest"), (line + newlines(span)).alias("line"),
            F.array_append(acc["hits"], F.struct(span.alias("span"), line.alias("line"))).alias("hits"),
        )

    nothing = F.array().cast(T.ArrayType(T.StructType([T.StructField("span", T.StringType()), T.StructField("line", T.IntegerType())])))
    start = F.struct(text.alias("rest"), F.lit(1).alias("line"), nothing.alias("hits"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, step, lambda acc: acc["hits"])


# source kind, file-name test, pattern (label, command), shell form
_DOCKER = r"(?mi)^\s*(CMD|ENTRYPOINT)\s+(.+)$"
_PROC = r"(?m)^\s*([A-Za-z0-9_-]+)\s*:\s*(.+)$"
_UNIT = r"(?mi)^\s*(ExecStart)\s*=\s*(.+)$"
_COMPOSE = r"(?mi)^\s*(command|entrypoint)\s*:\s*([^\n#]+)"


def deployment_commands(files: DataFrame) -> DataFrame:
    """Start commands in container, process and service files, with their line."""
    name = F.lower(base_name("path"))
    kind = (
        F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile_entrypoint").when(name == "procfile", "procfile")
        .when(name.endswith(".service"), "systemd_unit")
        .when(name.isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), "compose_command")
    )
    forms = {"dockerfile_entrypoint": _DOCKER, "procfile": _PROC, "systemd_unit": _UNIT, "compose_command": _COMPOSE}
    found, label, command = F.lit(None), F.lit(None), F.lit(None)
    for source, pattern in forms.items():
        is_kind = F.col("source_kind") == source
        found = F.when(is_kind, line_matches(F.col("text"), pattern)).otherwise(found)
        label = F.when(is_kind, F.regexp_extract("_m.span", pattern, 1)).otherwise(label)
        command = F.when(is_kind, F.trim(F.regexp_extract("_m.span", pattern, 2))).otherwise(command)
    hits = files.withColumn("source_kind", kind).filter("source_kind is not null").select("path", "source_kind", F.explode(found).alias("_m"))
    hits = hits.select("path", "source_kind", label.alias("label"), command.alias("command"), F.col("_m.line").alias("line"))
    hits = hits.withColumn("command", F.when(F.col("source_kind") == "compose_command", F.regexp_replace("command", "^['\"]+|['\"]+$", "")).otherwise(F.col("command")))
    plain = ~F.ltrim("command").startswith("[")
    shell = (
        F.when(F.col("source_kind") == "procfile", True).when(F.col("source_kind") == "systemd_unit", has_shell_syntax("command")).otherwise(plain)
    )
    purpose = F.when((F.col("source_kind") == "procfile") & (F.lower("label") != "web"), "worker").otherwise("serve")
    return hits.filter("command <> ''").withColumn("purpose", purpose).withColumn("shell_interpreted", shell)


def has_shell_syntax(command: Column | str) -> Column:
    return _col(command).rlike(r"&&|\|\||[|;`]|\$\(|\$\{")


def package_scripts(packages: DataFrame) -> DataFrame:
    """Scripts of package manifests (path, text) with their purpose."""
    parsed = packages.select("path", F.from_json("text", "scripts map<string,string>").alias("p"))
    rows = parsed.select("path", F.explode("p.scripts").alias("script", "command")).filter("trim(command) <> ''")
    name = F.col("script")
    purpose = (
        F.when(name.isin("start", "serve"), "serve").when(name.isin("dev", "preview"), "run").when(name.isin("build", "compile"), "build")
        .when(name.startswith("test"), "test").otherwise("unknown")
    )
    return rows.select(
        "path", "script", "command", purpose.alias("purpose"), name.isin("dev", "start", "serve", "preview").alias("is_entrypoint"),
        F.concat(F.lit("npm run "), name).alias("suggested_command"),
    )


def package_frameworks(packages: DataFrame) -> DataFrame:
    parsed = packages.select("path", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("p"))
    empty = F.create_map().cast("map<string,string>")
    names = F.array_distinct(F.concat(F.map_keys(F.coalesce("p.dependencies", empty)), F.map_keys(F.coalesce("p.devDependencies", empty))))
    known = F.create_map(*[F.lit(x) for pair in PACKAGE_FRAMEWORKS.items() for x in pair])
    return (
        parsed.select("path", F.explode(names).alias("dependency")).withColumn("framework", F.element_at(known, F.col("dependency"))).filter("framework is not null")
    )


def command_fact(command: Column | str) -> Column:
    """Struct of argv, launcher and shell flag; argv is empty for unbalanced quotes."""
    text = F.trim(_col(command))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    listed = F.when(F.size(listed) > 0, listed)
    quoted = r"\"(?:\\.|[^\"\\])*\"|'[^']*'"
    balanced = ~F.regexp_replace(text, quoted + r"|\\.", "").rlike("[\"']")
    words = F.regexp_extract_all(text, F.lit(r"(?:" + quoted + r"|\\.|[^\s\"'\\])+"), F.lit(0))
    split = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"(?<!\\)[\"']", ""), r"\\(.)", "$1"))
    argv = F.coalesce(listed, F.when(balanced, split), F.array().cast("array<string>"))
    return F.struct(
        text.alias("command"), argv.alias("argv"), F.when(F.size(argv) > 0, base_name(F.get(argv, F.lit(0)))).alias("launcher"),
        has_shell_syntax(text).alias("shell_interpreted"),
    )


def file_tree(files: DataFrame) -> DataFrame:
    """Parent-child rows of a tree of paths; entries with a leading dot are left out.

    One row per child with its number of files below, instead of one array per folder: a folder may be huge.
    """
    parts = F.split("path", "/")
    visible = files.filter(~F.exists(parts, lambda p: p.startswith(".")))
    depth = F.explode(F.sequence(F.lit(1), F.size(parts)))
    rows = visible.select("path", parts.alias("p"), depth.alias("depth")).select(
        F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/").alias("parent"), F.element_at("p", F.col("depth")).alias("name"),
        (F.col("depth") < F.size("p")).alias("is_folder"),
    )
    return rows.groupBy("parent", "name", "is_folder").agg(F.count("*").alias("files"))


def module_counts(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files per top folder (``.`` for the root), largest first; all of them unless the caller sets a limit."""
    module = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    counts = files.groupBy(module.alias("module")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "module")
    return counts if limit is None else counts.limit(limit)


def snapshot_manifest(files: DataFrame) -> DataFrame:
    """Digest, size and line count per file."""
    return files.select(
        "path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), line_count("text").cast("long").alias("lines")
    )


def snapshot_digest(manifest: DataFrame) -> DataFrame:
    """One digest over a whole manifest as a hash tree.

    Leaves are grouped by hash prefix, so a bucket stays small for any number of files; equal
    manifests give equal digests whatever their partitioning.
    """
    leaf = F.sha2(F.to_json(F.struct("path", "sha256", "bytes", "lines")), 256)
    level = manifest.select(F.substring(F.sha2("path", 256), 1, 6).alias("b"), leaf.alias("h"))
    for width in (3, 1, 0):
        level = (
            level.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
            .select(F.substring("b", 1, width).alias("b"), "h")
        )
    return level.groupBy().agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def scan_code_facts(lines: DataFrame) -> DataFrame:
    """Definitions, calls and imports that a line shows: (path, line, position, fact, name)."""
    token = lambda pattern, fact: F.transform(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x, i: F.struct(F.lit(fact).alias("fact"), (i + 1).alias("position"), x.alias("name")))
    facts = F.concat(
        token(r"\b(?:def|func|function|class|fn)\s+([A-Za-z_]\w*)", "definition"),
        token(r"(?:^|\s)(?:import|from|require|use)\s+([A-Za-z_][\w./]*)", "import"),
        token(r"(?<!def )(?<!func )(?<!fn )\b([A-Za-z_]\w*)\(", "call"),
    )
    return lines.select("path", "line", F.explode(facts).alias("_f")).select("path", "line", "_f.fact", "_f.position", "_f.name")


def select_map_lines(maps: DataFrame, question_terms: Sequence[str], keys: Sequence[str], max_lines: int = 140, header: int = 25) -> DataFrame:
    """Header lines, then lines that hold a term, else the first following lines; ``max_lines`` per map."""
    folded = F.lower("text")
    hit = F.lit(False)
    for term in question_terms:
        hit = hit | F.contains(folded, F.lit(term.lower()))
    hit = hit & (F.col("line") > header)
    marked = maps.withColumn("_hit", hit)
    any_hit = marked.groupBy(*keys).agg(F.max("_hit").alias("_any"))
    chosen = marked.join(any_hit, list(keys)).filter((F.col("line") <= header) | F.col("_hit") | (~F.col("_any") & (F.col("line") <= max_lines)))
    return top_n(chosen, keys, ["line"], max_lines, "_rn").drop("_hit", "_any", "_rn")


def snippets_around(
    lines: DataFrame, hits: DataFrame, context: int = 5, max_chars: int = 4000, role: str = "intermediate"
) -> DataFrame:
    """Snippet of +-``context`` lines around each hit (path, line, end_line).

    A snippet beyond ``max_chars`` keeps the focus line, then grows down, then up, and keeps the
    requested range. Lines are found by equi joins on line numbers, and only those that can fit are gathered.
    """
    numbered = lines.select("path", F.col("line").alias("n"), F.concat(F.col("line").cast("string"), F.lit(": "), F.col("text")).alias("shown"))
    ends = lines.groupBy("path").agg(F.max("line").alias("_last"))
    # a numbered line has at least four characters with its line end, so further lines cannot fit
    reach = F.least(F.col("end_line") + context, F.col("line") + max_chars // 4 + 1)
    wanted = hits.select("path", "line", "end_line").distinct().join(ends, "path").withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - context), reach)))
    cells = wanted.join(numbered, ["path", "n"]).withColumn("len", F.length("shown"))
    grouped = cells.groupBy("path", "line", "end_line").agg(
        F.array_sort(F.collect_list(F.struct("n", "shown", "len"))).alias("cells"), F.min("n").alias("req_start"),
        F.least(F.col("end_line") + context, F.max("_last")).alias("req_end"), (F.sum("len") + F.count("*") - 1).alias("chars"),
    )
    focus = F.filter("cells", lambda c: c["n"] == F.col("line"))
    down = F.filter("cells", lambda c: c["n"] > F.col("line"))
    up = F.reverse(F.filter("cells", lambda c: c["n"] < F.col("line")))
    too_long = F.concat(F.col("line").cast("string"), F.lit(": [line exceeds the snippet budget; read it at its position]"))
    first = F.when(F.get(focus, F.lit(0))["len"] > max_chars, too_long).otherwise(F.get(focus, F.lit(0))["shown"])

    def grow(cells_in: Column, start: Column) -> Column:
        """(used, count, open): take cells in order until the first that does not fit."""
        return F.aggregate(cells_in, start, lambda acc, c: F.when(
            acc["open"] & (acc["used"] + c["len"] + 1 <= max_chars),
            F.struct((acc["used"] + c["len"] + 1).alias("used"), (acc["taken"] + 1).alias("taken"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["used"].alias("used"), acc["taken"].alias("taken"), F.lit(False).alias("open"))))

    state = lambda used: F.struct(used.alias("used"), F.lit(0).alias("taken"), F.lit(True).alias("open"))
    work = grouped.withColumn("truncated", F.col("chars") > max_chars).withColumn("_first", first)
    work = work.withColumn("_down", grow(down, state(F.length("_first"))))
    work = work.withColumn("_up", grow(up, state(F.col("_down.used"))))
    whole = F.array_join(F.transform("cells", lambda c: c["shown"]), "\n")
    part = F.array_join(F.concat(
        F.transform(F.reverse(F.slice(up, 1, F.col("_up.taken"))), lambda c: c["shown"]), F.array("_first"),
        F.transform(F.slice(down, 1, F.col("_down.taken")), lambda c: c["shown"])), "\n")
    out = work.select(
        "path", "line", "end_line",
        F.when(F.col("truncated"), F.col("line") - F.col("_up.taken")).otherwise(F.col("req_start")).alias("start_line"),
        F.when(F.col("truncated"), F.col("line") + F.col("_down.taken")).otherwise(F.col("req_end")).alias("stop_line"),
        redact_literals(F.when(F.col("truncated"), part).otherwise(whole)).alias("text"), "truncated",
        F.when(F.col("truncated"), F.col("req_start")).alias("requested_start_line"), F.when(F.col("truncated"), F.col("req_end")).alias("requested_end_line"),
    )
    return out.withColumn("snippet_id", digest_id("snippet:", "path", F.lit(role), "start_line", "stop_line", "text"))


def rank_symbols(symbols: DataFrame, central: DataFrame, limit: int | None = None) -> DataFrame:
    """Symbols (id, kind, path, name) by score: 10 when central, 3 for types and callables; best first."""
    marked = symbols.join(central.select("id").distinct().withColumn("_central", F.lit(True)), "id", "left")
    score = F.when(F.col("_central"), 10).otherwise(0) + F.when(F.col("kind").isin("class", "function", "method", "interface"), 3).otherwise(0)
    ranked = marked.withColumn("score", score).drop("_central").orderBy(F.desc("score"), "path", "name", "id")
    return ranked if limit is None else ranked.limit(limit)


def search_symbols(symbols: DataFrame, text: str, limit: int) -> DataFrame:
    """Case-insensitive substring on name or qualified name; one row more than ``limit`` tells whether it was cut."""
    folded = F.lit(text.lower())
    hits = symbols.filter(F.contains(F.lower("name"), folded) | F.contains(F.lower("fqn"), folded)).orderBy("fqn", "id").limit(limit + 1)
    more = hits.agg(F.count("*") > limit).scalar()
    return hits.orderBy("fqn", "id").limit(limit).withColumn("truncated", more)


def duplicate_root_causes(rows: DataFrame, text: str) -> DataFrame:
    """Normalised texts that occur more than once."""
    normal = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return rows.groupBy(F.sha2(normal, 256).alias("digest")).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def overview(files: DataFrame) -> DataFrame:
    """Markdown summary per project from its aggregates; languages come from a closed catalogue."""
    stats = files.groupBy("project_id", "lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    per = stats.groupBy("project_id").agg(
        F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("langs"))
    languages = F.array_join(F.transform("langs", lambda x: F.concat(x["lang"], F.lit(" "), x["n"].cast("string"))), ", ")
    body = F.concat(F.lit("## "), "project_id", F.lit("\n\nLanguages: "), languages, F.lit("\n\n- files: "), F.col("files").cast("string"), F.lit("\n- bytes: "), F.col("bytes").cast("string"))
    return per.select("project_id", body.alias("overview"))


def check_repo_url(url: Column | str, hosts: Sequence[str] = ("github.com", "gitlab.com")) -> Column:
    """Why a repository address is refused; null when it may be used."""
    url = _col(url)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:\d*)?$|\.+(:\d*)?$", ""))
    return (
        F.when(~F.lower(scheme).isin("http", "https") | (host == ""), "scheme_or_host").when(F.contains(authority, F.lit("@")), "credentials")
        .when(~host.isin(*hosts), "host_not_allowed").when(host.isin("localhost", "localhost.localdomain"), "local_host")
    )


def symbol_outline(symbols: DataFrame) -> DataFrame:
    """Parent of each symbol (file, fqn, kind) by its dotted prefix; orphans go to the roots or a group."""
    known = symbols.select("file", F.col("fqn").alias("parent")).distinct().withColumn("_has", F.lit(True))
    prefix = F.when(F.contains("fqn", F.lit(".")), F.regexp_replace("fqn", r"\.[^.]*$", ""))
    joined = symbols.withColumn("parent", prefix).join(known, ["file", "parent"], "left")
    group = (
        F.when(F.col("_has"), "child").when(F.col("kind").isin("constant", "property"), "constants").when(F.col("kind") == "class", "root").otherwise("functions")
    )
    return joined.select("file", "fqn", "kind", F.when(F.col("_has"), F.col("parent")).alias("parent"), group.alias("placement"))


def mentions(texts: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """Ids that a text names as whole tokens: texts are tokenised once and meet the ids by an equi join."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\w:.-]+"), F.lit(0))))
    return texts.select(key, token.alias("id")).join(ids.select("id").distinct(), "id")


def project_inventory(projects: DataFrame, files: DataFrame, artifacts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sizes and flags per project; tables are aggregated before they meet."""
    size = lambda df, name: df.groupBy("project_id").agg(F.sum("bytes").alias(name))
    active = tasks.filter("active").select("project_id").distinct().withColumn("_active", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = projects.join(size(files, "workspace_bytes"), "project_id", "left").join(size(artifacts, "artifact_bytes"), "project_id", "left").join(active, "project_id", "left")
    return joined.select(
        "project_id", F.col("workspace_bytes").isNotNull().alias("workspace_exists"), F.col("artifact_bytes").isNotNull().alias("artifact_exists"),
        zero("workspace_bytes").alias("workspace_bytes"), zero("artifact_bytes").alias("artifact_bytes"),
        (zero("workspace_bytes") + zero("artifact_bytes")).alias("total_bytes"), F.coalesce("_active", F.lit(False)).alias("active_tasks"),
    )
