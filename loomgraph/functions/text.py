"""Column functions over paths and source text: language, hash, line count, path parts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: language of each file extension
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript",
    ".tsx": "typescriptreact",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascriptreact",
    ".py": "python",
    ".md": "markdown",
}
PLAIN = "plaintext"
SCANNED = ("typescript", "javascript", "typescriptreact", "javascriptreact")
# fixed values: extensions and folders of workspace discovery
INCLUDED = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "md")
EXCLUDED_FOLDERS = ("node_modules", "dist", ".git", "out", "build")
# fixed values: icon of each symbol kind
ICON_BY_KIND = {
    "function": "symbol-function",
    "class": "symbol-class",
    "interface": "symbol-interface",
    "type": "symbol-type-parameter",
    "enum": "symbol-enum",
    "variable": "symbol-variable",
}
OTHER_ICON = "symbol-misc"
#: Languages that an editor may index.
EDITOR_LANGUAGES = ("typescript", "javascript", "typescriptreact", "javascriptreact", "python", "markdown")


def _lookup(key: Column, table: dict[str, str], otherwise: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(otherwise))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the base name on, the dot included; none if that dot begins the name."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    return _lookup(F.lower(extension(path)), LANGUAGE_BY_EXTENSION, PLAIN)


def is_scanned(lang: Column) -> Column:
    """Whether files of this language are searched for declarations."""
    return lang.isin(*SCANNED)


def editor_supports(lang: Column) -> Column:
    return F.coalesce(lang.isin(*EDITOR_LANGUAGES), F.lit(False))


def decoded(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def line_count(text: Column) -> Column:
    """Parts between line feeds: 1 for an empty text, one more after a final line feed."""
    return F.size(F.split(text, "\n", -1)).cast("long")


def _parts(path: Column) -> Column:
    """The names along a path: empty ones and `.` go, `..` takes the name before it."""
    names = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda held: F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
    resolved = F.aggregate(names, F.array().cast("array<string>"), lambda held, x: F.when(x == "..", up(held)).otherwise(F.concat(held, F.array(x))))
    return F.when(path.rlike("(^|/)[.][.](/|$)"), resolved).otherwise(names)


def _steps(there: Column, here: Column) -> Column:
    """The steps from the folder with the names `here` to `there`."""
    same = lambda n, i: F.when((n == i - 1) & (F.get(there, n) == F.get(here, n)), i).otherwise(n)
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(there), F.size(here)))), F.lit(0), same)
    return F.concat(F.array_repeat(F.lit(".."), F.size(here) - common), F.slice(there, common + 1, F.size(there)))


def _plain(path: Column) -> Column:
    """Whether a path is written without `.`, `..` and doubled slashes."""
    return ~path.rlike("(^|/)[.]{1,2}(/|$)|//")


def relative_path(root: Column, path: Column, outside: bool = True) -> Column:
    """The path from root with forward slashes; with outside, also `../` paths of files that aren't under root."""
    base = F.regexp_replace(root, "/+$", "")
    inside = F.when(path.startswith(F.concat(base, F.lit("/"))) & _plain(path), path.substr(F.length(base) + F.lit(2), F.length(path)))
    inside = inside.when(path == base, F.lit(""))
    if not outside:
        return inside
    # an array of one struct, so that both lists of names are made once
    both = F.array(F.struct(_parts(path).alias("there"), _parts(root).alias("here")))
    steps = F.get(F.transform(both, lambda x: _steps(x["there"], x["here"])), 0)
    return inside.when(root.isNotNull() & path.isNotNull(), F.array_join(steps, "/"))


def absolute_path(root: Column, relative: Column) -> Column:
    """root joined with a relative path, `..` resolved; without root the relative path alone."""
    whole = F.concat_ws("/", F.regexp_replace(root, "/+$", ""), relative)
    resolved = F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(_parts(whole), "/"))
    return F.when(root.isNull() | (root == ""), relative).when(_plain(relative), whole).otherwise(resolved)


def in_workspace(relative: Column) -> Column:
    """Whether discovery takes the file: an included extension, and no excluded folder at any depth."""
    folders = "|".join(f.replace(".", "[.]") for f in EXCLUDED_FOLDERS)
    wanted = relative.rlike(rf"[.]({'|'.join(INCLUDED)})$")
    return wanted & ~F.concat(F.lit("/"), relative).rlike(f"/({folders})/")


def icon(kind: Column) -> Column:
    return _lookup(kind, ICON_BY_KIND, OTHER_ICON)


def symbol_label(name: Column, kind: Column) -> Column:
    return F.concat(name, F.lit(" ("), kind, F.lit(")"))


def titled_label(name: Column, kind: Column) -> Column:
    """The label with the kind's first letter in upper case."""
    return symbol_label(name, F.concat(F.upper(F.substring(kind, 1, 1)), kind.substr(F.lit(2), F.length(kind))))


def line_of(start_line: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.coalesce(start_line.cast("long"), F.lit(0).cast("long")))


def stable_id(*parts: Column) -> Column:
    """A deterministic id: a random one would differ each time that Spark computes it anew."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def row_id(*parts: Column) -> Column:
    """The same of 128 bits, as many as a UUID has: ids of symbols and edges, of which there are many, are most of what a store takes."""
    return F.substring(stable_id(*parts), 1, 32)
