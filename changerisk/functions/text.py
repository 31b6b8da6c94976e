"""Paths, identifiers, constraint text and secrets as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions.binding import let
from changerisk.seeds import literal_map, tables


# --- paths -------------------------------------------------------------------
def normalize_path(path: Column) -> Column:
    """Repository-relative path with forward slashes and no leading ``./`` or ``/``."""
    trimmed = F.regexp_replace(path, r"^\s+|\s+$", "")
    return F.regexp_replace(F.replace(trimmed, F.lit("\\"), F.lit("/")), r"^(\./)*/*", "")


def framework_of(path: Column) -> Column:
    """``struct<framework, source_kind>`` of the first layout that fits, else NULL.

    Layouts are read off the folders and the file name; a file name needs
    something before its suffix.
    """
    def found(parts: Column) -> Column:
        name = F.element_at(parts, F.lit(-1))
        folder = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-1 - k)), F.lit(""))
        folders = F.slice(parts, F.lit(1), F.size(parts) - 1)

        def ends(suffix: str) -> Column:
            return name.endswith(suffix) & (F.length(name) > len(suffix))

        version = F.substring_index(F.substr(name, F.lit(2)), "__", 1)
        versioned = (F.substr(name, F.lit(1), F.lit(1)).isin("V", "U") & name.contains("__")
                     & F.substr(version, F.lit(1), F.lit(1)).between("0", "9")
                     & (F.translate(version, "0123456789_.", "") == ""))
        module = ends(".py") & (name != "__init__.py")
        layouts = [
            ("prisma", (folder(3) == "prisma") & (folder(2) == "migrations") & (folder(1) != "")
             & (name == "migration.sql")),
            ("rails", (folder(1) == "migrate") & ends(".rb")
             & ((folder(2) == "db") | ((folder(3) == "db") & (folder(2) != "")))),
            ("alembic", (folder(1) == "versions") & module),
            ("django", (folder(1) == "migrations") & module),
            ("flyway", versioned & name.endswith(".sql")),
            ("flyway", name.startswith("R__") & name.endswith(".sql") & (F.length(name) > 7)),
            ("golang_migrate", ends(".up.sql") | ends(".down.sql")),
            ("generic", F.arrays_overlap(folders, F.array(F.lit("migration"), F.lit("migrations")))
             & ends(".sql")),
        ]
        out = F.coalesce(*[F.when(fits, F.lit(framework)) for framework, fits in layouts])
        return let(out, lambda f: F.when(f.isNotNull(), F.struct(
            f.alias("framework"),
            F.try_element_at(literal_map(tables.FRAMEWORK_KIND), f).alias("source_kind"))))

    return let(F.split(path, "/"), found)


def glob_to_regex(glob: str) -> str:
    """Path glob as a regular expression: ``*`` stays in a segment, ``**`` crosses them."""
    glob = re.sub(r"^(\./)*/*", "", glob.strip().replace("\\", "/"))
    token = re.compile(r"\*\*/|\*\*|\*|\?|\[[!^]?[^\]]+\]|.", re.S)
    fixed = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def translate(part: str) -> str:
        if part in fixed:
            return fixed[part]
        if len(part) > 1 and part.startswith("["):
            body = part[1:-1]
            return "[^" + body[1:] + "]" if body[0] in "!^" else f"[{body}]"
        return re.escape(part)

    return "^" + "".join(translate(m.group()) for m in token.finditer(glob)) + "$"


def _any_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))


def detect_scripts(paths: DataFrame, include: list[str] | None = None,
                   exclude: list[str] | None = None) -> DataFrame:
    """Change scripts among ``paths(path)``: distinct, with framework and source kind.

    ``include`` replaces detection; ``exclude`` is applied last.
    """
    clean = (paths.select(normalize_path(F.col("path")).alias("path"))
             .filter(F.col("path") != "").distinct())
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    configured = F.struct(
        F.lit("configured").alias("framework"),
        F.coalesce(F.try_element_at(literal_map(tables.EXTENSION_KIND), suffix),
                   F.lit("sql")).alias("source_kind"))
    found = framework_of(F.col("path"))
    if include:
        kept = clean.filter(_any_glob(F.col("path"), include))
        found = F.coalesce(found, configured)
    else:
        kept = clean
    kept = kept.withColumn("found", found).filter(F.col("found").isNotNull())
    if exclude:
        kept = kept.filter(~_any_glob(F.col("path"), exclude))
    return kept.select("path", "found.framework", "found.source_kind")


# --- identifiers -------------------------------------------------------------
def quote_identifier(part: Column) -> Column:
    """An identifier the server reads back unchanged."""
    return F.when(part.rlike(r"^[a-z_][a-z0-9_$]*$"), part).otherwise(
        F.concat(F.lit('"'), F.replace(part, F.lit('"'), F.lit('""')), F.lit('"')))


def render_name(schema: Column, name: Column) -> Column:
    return F.when(schema.isNull(), quote_identifier(name)).otherwise(
        F.concat(quote_identifier(schema), F.lit("."), quote_identifier(name)))


# --- constraint text -----------------------------------------------------------
def strip_outer_parens(text: Column) -> Column:
    """Drop the parenthesis pairs that enclose the whole text.

    As many layers go as the depth never falls below between the leading and
    the trailing run of parentheses.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\(\s+", "("), r"\s+\)", ")"))
    lead = F.length(F.regexp_extract(text, r"^(\(*)", 1))
    trail = F.length(F.regexp_extract(text, r"(\)*)$", 1))
    inner = F.regexp_replace(F.regexp_replace(text, r"^\(*", ""), r"\)*$", "")
    start = F.struct(lead.alias("depth"), lead.alias("low"))
    walked = F.aggregate(
        F.regexp_extract_all(inner, F.lit(r"[()]"), F.lit(0)), start,
        lambda acc, c: F.struct(
            (acc["depth"] + F.when(c == "(", 1).otherwise(-1)).alias("depth"),
            F.least(acc["low"], acc["depth"] + F.when(c == "(", 1).otherwise(-1)).alias("low")))
    layers = F.greatest(F.least(lead, trail, walked["low"]), F.lit(0))
    return F.trim(F.substr(text, layers + 1, F.length(text) - 2 * layers))


def split_top_level_and(text: Column) -> Column:
    """Conjuncts of a condition; an AND inside parentheses does not split."""
    def depth(piece: Column) -> Column:
        opens = F.length(piece) - F.length(F.replace(piece, F.lit("("), F.lit("")))
        closes = F.length(piece) - F.length(F.replace(piece, F.lit(")"), F.lit("")))
        return opens - closes

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("depth"))

    def step(acc: Column, piece: Column) -> Column:
        last = F.try_element_at(acc["parts"], F.lit(-1))
        head = F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))
        fresh = F.concat(acc["parts"], F.array(piece))
        joined = F.concat(head, F.array(F.concat(last, F.lit(" AND "), piece)))
        return F.struct(F.when(acc["depth"] == 0, fresh).otherwise(joined).alias("parts"),
                        (acc["depth"] + depth(piece)).alias("depth"))

    return F.aggregate(F.split(text, r"(?i)\s+AND\s+"), start, step, lambda acc: acc["parts"])


def proves_not_null(expression: Column, column: Column) -> Column:
    """Does a CHECK expression state that ``column`` is not null?"""
    pattern = r'(?i)^"?([^"]+)"?\s+IS\s+NOT\s+NULL$'
    wanted = F.replace(column, F.lit('"'), F.lit(""))

    def states(part: Column) -> Column:
        bare = strip_outer_parens(part)
        return bare.rlike(pattern) & (F.regexp_extract(bare, pattern, 1) == wanted)

    return F.exists(split_top_level_and(strip_outer_parens(expression)), states)


# --- secrets -------------------------------------------------------------------
def _unquote(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def parse_conninfo(conninfo: Column) -> Column:
    """Parameters of a connection string as a map; URI and keyword forms."""
    text = F.trim(conninfo)
    scheme = F.split(F.lower(F.substring_index(text, "://", 1)), r"\+")
    is_uri = (text.contains("://") & F.get(scheme, F.lit(0)).isin(*tables.SCHEMES)
              & ((F.size(scheme) == 1) | ((F.size(scheme) == 2) & F.get(scheme, F.lit(1)).rlike(r"^\w+$"))))
    return F.when(is_uri, _uri_params(text)).otherwise(_keyword_params(text))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _first_wins(entries: Column) -> Column:
    """Map of the non-empty entries; the first value of a repeated key stays."""
    start = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.aggregate(
        entries, start, lambda acc, e: F.when(
            F.exists(acc, lambda seen: seen["key"] == e["key"]), acc).otherwise(
            F.concat(acc, F.array(e)))))


def _uri_params(text: Column) -> Column:
    rest = F.substr(text, F.instr(text, "://") + 3)
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    userinfo = F.regexp_extract(authority, r"^(.*)@", 1)
    user = F.regexp_extract(userinfo, r"^([^:]*)", 1)
    password = F.regexp_extract(userinfo, r"^[^:]*:(.*)$", 1)
    servers = F.split(F.regexp_extract(authority, r"([^@]*)$", 1), ",")
    hosts = F.filter(F.transform(servers, lambda s: F.regexp_replace(
        F.regexp_extract(s, r"^(.*?)(?::([^:\]]*))?$", 1), r"^[\[\]]+|[\[\]]+$", "")),
        lambda h: h != "")
    port = F.try_element_at(F.filter(F.transform(servers, lambda s: F.regexp_extract(
        s, r":([^:\]]*)$", 1)), lambda p: p != ""), F.lit(1))
    dbname = F.regexp_extract(rest, r"^[^/?#]*/+([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    named = F.filter(F.array(
        _pair(F.lit("user"), _unquote(user)), _pair(F.lit("password"), _unquote(password)),
        _pair(F.lit("port"), F.coalesce(port, F.lit(""))),
        _pair(F.lit("dbname"), _unquote(dbname))), lambda e: e["value"] != "")
    host_entries = F.transform(hosts, lambda h, i: _pair(
        F.when(i == 0, "host").otherwise(F.concat(F.lit("host"), i.cast("string"))), h))
    extras = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=")),
        lambda p: _pair(_unquote(F.regexp_extract(p, r"^([^=]+)=", 1)),
                        _unquote(F.regexp_extract(p, r"^[^=]+=(.*)$", 1))))
    return _first_wins(F.concat(named, host_entries, extras))


def _keyword_params(text: Column) -> Column:
    pairs = F.regexp_extract_all(
        text, F.lit(r"([^\s=]+\s*=\s*(?:'(?:[^'\\]|\\.)*'?|(?:[^\s\\']|\\.)(?:[^\s\\]|\\.)*|))"),
        F.lit(1))

    def entry(p: Column) -> Column:
        raw = F.regexp_extract(p, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
        bare = F.when(raw.startswith("'"), F.regexp_replace(raw, r"(?s)^'|(?<!\\)'$", "")
                      ).otherwise(raw)
        return _pair(F.regexp_extract(p, r"^([^\s=]+)", 1),
                     F.regexp_replace(bare, r"(?s)\\(.)", "$1"))

    # the last value of a repeated key wins here, so read them backwards
    return _first_wins(F.reverse(F.transform(pairs, entry)))


def secret_literals(conninfo: Column) -> Column:
    """Texts to hide for one connection string, longest first.

    The whole string and any password always count; hosts, users and database
    names count unless they are short or too common to matter.
    """
    return let(F.trim(conninfo), lambda text: let(
        parse_conninfo(text), lambda params: _literals_of(text, params)))


def _literals_of(text: Column, params: Column) -> Column:
    generic = F.array(*[F.lit(w) for w in tables.GENERIC_WORDS])
    password = F.try_element_at(params, F.lit("password"))
    parts = F.transform(
        F.filter(F.map_entries(params), lambda e: e["key"].rlike("^(host|user|dbname)")),
        lambda e: F.trim(e["value"]))
    named = F.filter(parts, lambda v: (F.length(v) >= tables.MIN_LITERAL)
                     & ~F.array_contains(generic, F.lower(v)))
    literals = F.array_distinct(F.concat(
        F.filter(F.array(text), lambda t: (t != "") & ~F.array_contains(generic, F.lower(t))),
        F.filter(F.array(password), lambda p: F.length(p) >= tables.MIN_PASSWORD), named))
    return longest_first(literals)


def longest_first(literals: Column) -> Column:
    """Order literals so that a whole string is replaced before its parts."""
    return F.array_sort(literals, lambda a, b: F.coalesce(
        F.nullif(F.length(b) - F.length(a), F.lit(0)),
        F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def _hide_after(text: Column, signs: tuple[str, ...], lead: str, end: Callable[[Column], Column],
                shown: Callable[[Column], Column]) -> Column:
    """Text with the value after every ``lead`` hidden.

    ``end`` gives the length of the value that a piece begins with, NULL where
    it begins with none; ``shown`` is what stays of the lead before it. Texts
    without any of ``signs``, one of which every match holds, are left at once.
    The control characters 1 and 2 become blanks in a text with a lead.
    """
    begin, behind = "\u0001", "\u0002"

    def piece(p: Column) -> Column:
        lead_text, value = F.substring_index(p, behind, 1), F.substr(p, F.instr(p, behind) + 1)
        return let(value, lambda v: let(end(v), lambda n: F.when(
            n.isNull(), F.concat(lead_text, v)).otherwise(
            F.concat(shown(lead_text), F.lit(tables.PLACEHOLDER), F.substr(v, n + 1)))))

    def hidden(t: Column) -> Column:
        # One scan marks the leads, the marks cut the text.
        plain = F.when(t.contains(begin) | t.contains(behind),
                       F.translate(t, begin + behind, "  ")).otherwise(t)
        marked = F.regexp_replace(plain, lead, f"{begin}$0{behind}")
        return let(F.split(marked, begin), lambda pieces: F.when(F.size(pieces) < 2, t).otherwise(
            F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(
                F.slice(pieces, F.lit(2), F.size(pieces) - 1), piece), ""))))

    return let(text, lambda t: F.when(reduce(or_, [t.contains(s) for s in signs]),
                                      hidden(t)).otherwise(t))


def _run_to(text: Column, signs: str) -> Column:
    """Length of the text before the first blank or one of ``signs``."""
    stops = "\t\n\x0b\f\r" + signs
    first = F.translate(F.substring_index(text, " ", 1), stops, " " * len(stops))
    return F.length(F.substring_index(first, " ", 1))


def _password_end(text: Column) -> Column:
    first, run = F.substr(text, F.lit(1), F.lit(1)), _run_to(text, "'\",;")
    # What a backslash covers cannot close a single quote.
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("..")), F.lit("\\'"), F.lit(".."))
    closed = F.when(first == "'", F.locate("'", plain, 2)).when(
        first == '"', F.locate('"', text, 2))
    return F.nullif(F.coalesce(closed, run), F.lit(0))


def _server_end(text: Column) -> Column:
    first = F.substr(text, F.lit(1), F.lit(1))
    closed = F.nullif(F.when(first == "'", F.locate("'", text, 2)).when(
        first == '"', F.locate('"', text, 2)), F.lit(0))
    after = F.substr(text, closed + 1)
    bracket = F.when(F.ltrim(after).startswith("("), F.locate(")", after)).otherwise(0)
    return closed + bracket


def scrub(text: Column, literals: Column) -> Column:
    """Replace known literals, then connection strings, passwords and server names."""
    hide = tables.PLACEHOLDER
    known = F.aggregate(literals, text, lambda acc, s: F.replace(acc, s, F.lit(hide)))
    scheme = rf"(?i)\b(?:{'|'.join(tables.SCHEMES)})(?:\+\w+)?://"
    # A scheme inside a URI belongs to it: what both leave is one placeholder.
    out = _hide_after(known, ("://",), scheme, lambda p: _run_to(p, tables.URI_END), lambda _: F.lit(""))
    out = F.regexp_replace(out, f"(?:{re.escape(hide)}){{2,}}", hide)
    # A keyword is never another one's value, so the text behind the last one is what goes.
    keys = rf"(?i)\b(?:{'|'.join(tables.PASSWORD_KEYS)})\s*=\s*"
    out = _hide_after(out, ("=",), keys, _password_end,
                      lambda k: F.concat(F.regexp_extract(k, r"^(\w+)", 1), F.lit("=")))
    return _hide_after(out, ("'", '"'), rf"(?i)(?:{'|'.join(tables.SERVER_LEADS)})", _server_end,
                       lambda k: k)


# --- rationales ----------------------------------------------------------------
def rationale_bucket(rationale: Column) -> Column:
    out = None
    for bucket, phrase in tables.RATIONALE_BUCKETS:
        test = F.contains(rationale, F.lit(phrase))
        out = F.when(test, bucket) if out is None else out.when(test, bucket)
    return out.otherwise("other")
