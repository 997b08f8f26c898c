"""Column functions over document text and paths; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The directive language.
DIRECTIVE = r"(?Umd)^\s*@(include|delegate|ref)\s+([\w./_-]+\.md)(\s+--parallel)?\s*$"
READ_REF = r"""(?Umd)(?:Read|See)\s+[`"']([^`"']*?/[^`"']+\.md)[`"']|^\s*-\s+[`"']([^`"']*?/[^`"']+\.md)[`"']"""
PLACEHOLDER = r"(?U)\{\{(\w+)\}\}"
FRONTMATTER = r"(?s)\A---\s*\n.*?\n---\s*\n"
QUOTED = r"""[`"']([^`"']*?/[^`"']+\.md)[`"']"""
INLINE_MARKUP = (r"`([^`]+)`", r"\[([^\]]+)\]\([^)]+\)", r"\*{1,3}([^*]+)\*{1,3}")
TOP_HEADING = r"(?U)^\s*#\s+(.+?)\s*$"
TYPE_WORDS = (("agent", "agent"), ("shared", "shared"), ("prompt", "prompt"), ("reference", "reference"), ("asset", "template"), ("template", "template"))
MARKDOWN = (".md", ".markdown")
BINARY = tuple(".pdf .doc .docx .xls .xlsx .xlsm .ppt .pptx .odt .ods .odp .jpg .jpeg .png .gif .svg .webp .heic .bmp .tiff .tif .ico .mp3 .mp4 .m4a .wav .mov .avi .mkv .webm .zip .tar .gz .tgz .bz2 .7z .rar .exe .dll .so .dylib .bin .dat".split())
EDITABLE = tuple(".md .txt .rst .csv .html .xml .json .yaml .yml".split())
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
DESCRIPTION_CHARS, HASH_CHARS = 200, 16


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def directives(text: Column) -> Column:
    """ARRAY<STRUCT<type, target, parallel>> in the order of the text: the pattern runs once, each match is cut at its white space."""

    def fields(match: Column) -> Column:
        parts = F.split(strip(match), r"(?U)\s+")
        return F.struct(F.substr(parts[0], F.lit(2)).alias("type"), parts[1].alias("target"), (F.size(parts) > 2).alias("parallel"))

    return F.transform(_all(text, DIRECTIVE, 0), fields)


def read_refs(text: Column) -> Column:
    """Distinct paths of prose references, in the order of the text."""
    return F.array_distinct(F.transform(_all(text, READ_REF, 0), lambda m: F.regexp_extract(m, QUOTED, 1)))


def placeholders(text: Column) -> Column:
    return F.array_distinct(_all(text, PLACEHOLDER, 1))


def inline_plain(text: Column) -> Column:
    """Without inline code, links and emphasis."""
    for pattern in INLINE_MARKUP:
        text = F.regexp_replace(text, pattern, "$1")
    return strip(text)


def body_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, FRONTMATTER, ""), LINE_BREAK, -1)


def title(text: Column) -> Column:
    """The first top heading, or the empty string."""
    heads = F.filter(body_lines(text), lambda x: x.rlike(TOP_HEADING))
    return F.coalesce(inline_plain(F.regexp_extract(F.try_element_at(heads, F.lit(1)), TOP_HEADING, 1)), F.lit(""))


def description(text: Column) -> Column:
    """The first paragraph: lines that are neither headings nor directives; those lines don't end it, blank ones do."""
    start = F.struct(F.lit("").alias("said"), F.lit(False).alias("done"))

    def step(state: Column, line: Column) -> Column:
        bare = strip(line)
        skip = bare.startswith("#") | line.rlike(DIRECTIVE)
        done = state["done"] | ((bare == "") & (state["said"] != ""))
        add = ~done & (bare != "") & ~skip
        said = F.when(add, F.concat(state["said"], F.when(state["said"] != "", " ").otherwise(""), bare)).otherwise(state["said"])
        return F.struct(said.alias("said"), done.alias("done"))

    text = inline_plain(F.aggregate(body_lines(text), start, step)["said"])
    return F.when(F.length(text) > DESCRIPTION_CHARS, F.concat(F.regexp_replace(F.substring(text, 1, DESCRIPTION_CHARS - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_CHARS)


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def resolve_path(source: Column, target: Column) -> Column:
    """The target seen from the source's folder, with ``.`` and ``..`` folded."""
    parts = F.split(F.concat_ws("/", F.regexp_extract(source, "^(.*)/[^/]*$", 1), target), "/")

    def fold(out: Column, part: Column) -> Column:
        up = F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) != ".."), F.slice(out, 1, F.size(out) - 1)).otherwise(F.concat(out, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot; dotfiles have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.startswith("."))


def is_office_lock(path: Column) -> Column:
    return base_name(path).startswith("~$")


def has_cjk_name(path: Column) -> Column:
    return base_name(path).rlike("[\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]")


def kind_of(ext: Column) -> Column:
    """markdown, binary or text, by extension."""
    return F.when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*BINARY), "binary").otherwise("text")


def is_editable(path: Column) -> Column:
    """Whether directives may be written into the file."""
    return suffix(path).isin(*EDITABLE)


def human_bytes(n: Column, gap: str = "") -> Column:
    """1.0KB, or 1.0 KB with a gap: steps of 1024 and from there on tenths, exact ties to the even one."""

    def tenths(power: int, name: str) -> Column:
        size = F.lit(1024**power)
        whole, rest = F.floor(n * 10 / size).cast("long"), F.pmod(n * 10, size) * 2
        up = (rest > size) | ((rest == size) & (whole % 2 == 1))
        whole = whole + up.cast("long")
        return F.concat(F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"), F.lit(f"{gap}{name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(f"{gap}B"))).when(n < 1024**2, tenths(1, "KB")).when(n < 1024**3, tenths(2, "MB")).otherwise(tenths(3, "GB"))


def relative(path: Column, root: Column) -> Column:
    """The path below the root, or the path itself where it lies elsewhere."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def json_body(text: Column) -> Column:
    """What a fenced block marked json holds, else the whole text, stripped."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(F.contains(text, F.lit("```json")) & (fenced != ""), fenced).otherwise(strip(text))


def prompt_block(path: Column, summary: Column) -> Column:
    return F.concat(F.lit("### "), path, F.lit("\n```\n"), summary, F.lit("\n```"))


def node_type(path: Column, words: tuple = TYPE_WORDS) -> Column:
    out = F.when(F.lower(base_name(path)) == "skill.md", "skill")
    for word, kind in words:
        out = out.when(F.contains(F.lower(path), F.lit(word)), kind)
    return out.otherwise("reference")


def substitute(text: Column, variables: dict[str, str]) -> Column:
    """Literal replacement of each {{name}}, one after the other."""
    for name, value in variables.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    return text
