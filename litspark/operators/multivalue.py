"""Several values packed in one field, unpacked into one row per value.

The cell is split on quote characters.  Odd pieces are literals; even pieces are split on delimiters; array
folds put the values together again, with their ordinals.  Everything is a Column expression, so it runs in
the JVM; cells without quotes and brackets (most of them) take a plain ``split`` instead of the fold.

Defined results: null, blank and placeholder values give no row and take up no position; an odd number of
quotes makes the quotes ordinary characters; unbalanced brackets are ordinary characters; repeated rows give
repeated rows (the caller decides on ``distinct``); other columns of the input are kept out of the result, so
clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for nothing, and marks for further unnamed authors.
PLACEHOLDERS = (
    "none", "n/a", "na", "n.a.", "n. a.", "n/a.", "nan", "null", "nil", "-", "--", "---", "–", "—", "?", ".",
    "unknown", "not available", "not applicable", "not specified", "not reported", "not known", "tbd", "[]", "{}",
)
FURTHER_NAMES = r"(?iu)^(?:and |& |\+ ?)?(?:et\.? ?al\.?|others?|\d+ (?:more|others)|more|coll\.?)(?: ?…| ?\.\.\.)?$|^(?:…|\.{2,})$"
FURTHER_TAIL = r"(?iu)[\s,]+(?:et\.? ?al\.?|and (?:\d+ )?others)$"


@dataclass(frozen=True)
class Packing:
    """How one kind of field is packed.

    strong: pattern of what always separates values.  commas: ``split`` (a comma separates), or ``names`` (a comma
    separates full names, but joins a family name to a given name).  slash: a slash separates.  spaces: upper-case
    symbols separated by blanks alone are values of their own.  further: drop marks for further unnamed people.
    """

    commas: str = "split"
    slash: bool = True
    spaces: bool = False
    further: bool = False

    @property
    def delimiter(self) -> str:
        chars = ";；|\\n\\r\\t、•" + (",，" if self.commas == "split" else "") + ("/" if self.slash else "")
        return rf"\s*(?:[{chars}]\s*|,?\s(?:and|&|\+)\s+)"


TRANSGENES = Packing(slash=False)
TARGETS = Packing(spaces=True)
AUTHORS = Packing(commas="names", further=True)


def _sql(text: str) -> str:
    """A SQL string literal, raw enough for regular expressions."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cell(raw: Column) -> Column:
    """JSON lists are written anew as quoted, comma-separated literals; anything else stays."""
    text = F.trim(raw.cast("string"))
    listed = F.from_json(text, "array<string>")
    quoted = F.array_join(
        F.transform(F.filter(listed, lambda v: v.isNotNull()), lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))), ";"
    )
    plain = F.when(text.contains("/"), F.regexp_replace(text, r"(?i)(?<![a-z0-9])n/a(?![a-z0-9])", "n.a.")).otherwise(text)
    return F.when(text.startswith("[") & text.endswith("]") & listed.isNotNull(), quoted).otherwise(plain)


_INIT = "named_struct('vals', cast(array() as array<struct<v:string,lit:boolean>>), 'raw', '', 'lit', cast(null as string), 'mixed', false, 'depth', 0)"
_VALUE = "named_struct('v', if(a.lit is not null and not a.mixed, trim(a.lit), trim(a.raw)), 'lit', a.lit is not null and not a.mixed)"
_FLUSH = f"named_struct('vals', concat(a.vals, array({_VALUE})), 'raw', '', 'lit', cast(null as string), 'mixed', false, 'depth', 0)"


def _text(t: str, depth: str = "a.depth") -> str:
    return f"named_struct('vals', a.vals, 'raw', concat(a.raw, {t}), 'lit', a.lit, 'mixed', a.mixed or (a.lit is not null and trim({t}) <> ''), 'depth', {depth})"


def _folded(cell: str, packing: Packing) -> str:
    """SQL of the values of a cell with quotes or brackets: array<struct<v, lit>>."""
    d = packing.delimiter
    token = _sql(rf"{d}|[,()\[\]{{}}]|(?:(?!{d})[^,()\[\]{{}}])+" if packing.commas == "names" else rf"{d}|[()\[\]{{}}]|(?:(?!{d})[^()\[\]{{}}])+")
    opens, closes = f"length(regexp_replace({cell}, '[^(\\\\[{{]', ''))", f"length(regexp_replace({cell}, '[^)\\\\]}}]', ''))"
    kind = (
        f"case when t rlike {_sql('^(?:' + d + ')$')} then 1 when {opens} = {closes} and t in ('(', '[', '{{') then 2 "
        f"when {opens} = {closes} and t in (')', ']', '}}') then 3 when t = ',' then 5 else 0 end"
    )
    even = f"transform(regexp_extract_all(p, {token}, 0), t -> named_struct('k', {kind}, 't', t))"
    pieces = f"if(size(split({cell}, '\"')) % 2 = 0, array({cell}), split({cell}, '\"'))"
    tokens = f"flatten(transform({pieces}, (p, i) -> if(i % 2 = 1, array(named_struct('k', 4, 't', p)), {even})))"
    literal = (
        "case when a.lit is null and trim(a.raw) = '' then named_struct('vals', a.vals, 'raw', concat(a.raw, '\"', x.t, '\"'), 'lit', x.t, 'mixed', false, 'depth', a.depth) "
        "when a.lit is not null and not a.mixed and a.raw like '%\"' then named_struct('vals', a.vals, 'raw', concat(a.raw, '\"', x.t, '\"'), 'lit', concat(a.lit, '\"', x.t), 'mixed', false, 'depth', a.depth) "
        "else named_struct('vals', a.vals, 'raw', concat(a.raw, '\"', x.t, '\"'), 'lit', a.lit, 'mixed', a.lit is not null, 'depth', a.depth) end"
    )
    soft = _text("if(a.depth > 0, ',', '\\u0001')")
    step = (
        f"case when x.k = 4 then {literal} when x.k = 1 and a.depth = 0 then {_FLUSH} when x.k = 2 then {_text('x.t', 'a.depth + 1')} "
        f"when x.k = 3 then {_text('x.t', 'greatest(a.depth - 1, 0)')} when x.k = 5 and a.depth = 0 and a.lit is not null and not a.mixed then {_FLUSH} when x.k = 5 then {soft} else {_text('x.t')} end"
    )
    return f"aggregate({tokens}, {_INIT}, (a, x) -> {step}, a -> concat(a.vals, array({_VALUE})))"


def _plain(cell: str, packing: Packing) -> str:
    text = f"replace({cell}, ',', '\\u0001')" if packing.commas == "names" else cell
    return f"transform(split({text}, {_sql(packing.delimiter)}), v -> named_struct('v', trim(v), 'lit', false))"


def _named(values: str) -> str:
    """Second stage for names: a comma separates where each part is a full name, else it joins family and given name."""
    parts = "filter(transform(split(s.v, '\\u0001'), p -> trim(p)), p -> p <> '')"
    pairs = f"transform(sequence(0, cast(size({parts}) / 2 as int) - 1), i -> concat({parts}[2 * i], ', ', {parts}[2 * i + 1]))"
    whole = "regexp_replace(replace(s.v, '\\u0001', ','), '^[\\\\s,]+|[\\\\s,]+$', '')"
    return (
        f"flatten(transform({values}, s -> case when s.lit or not contains(s.v, '\\u0001') then array(s.v) when forall({parts}, p -> p rlike '\\\\S\\\\s+\\\\S') then {parts} "
        f"when size({values}) = 1 and size({parts}) >= 4 and size({parts}) % 2 = 0 then {pairs} else array({whole}) end))"
    )


def unpack(df: DataFrame, column: str, packing: Packing, keys: list[str]) -> DataFrame:
    """One row per value of ``column``: the keys, ``pos`` (from 1) and ``val``.

    keys are SQL expressions with aliases over df's columns, such as ``cast(id as string) as row_key``.
    """
    values = f"if(__cell rlike '[\"(\\\\[{{]', {_folded('__cell', packing)}, {_plain('__cell', packing)})"
    if packing.commas == "names":
        rest = _named("__vals")
    elif packing.spaces:
        rest = "flatten(transform(__vals, s -> if(not s.lit and s.v rlike '^[A-Z][A-Z0-9-]*(?:\\\\s+[A-Z][A-Z0-9-]*)+$', split(s.v, '\\\\s+'), array(s.v))))"
    else:
        rest = "transform(__vals, s -> s.v)"
    staged = df.select(*[F.expr(k) for k in keys], _cell(F.col(column)).alias("__cell")).where("__cell is not null")
    staged = staged.withColumn("__vals", F.expr(values)).withColumn("__flat", F.expr(rest))
    # SQL trim strips blanks only; any white space and zero-width characters go here
    flat = F.transform("__flat", lambda v: F.regexp_replace(v, r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$", ""))
    if packing.further:
        flat = F.transform(flat, lambda v: F.regexp_replace(v, FURTHER_TAIL, ""))
        flat = F.filter(flat, lambda v: ~v.rlike(FURTHER_NAMES))
    flat = F.filter(flat, lambda v: (v != "") & ((F.length(v) > 16) | ~F.lower(v).isin(*PLACEHOLDERS)))
    names = [c for c in staged.columns if not c.startswith("__")]
    return staged.select(*names, F.posexplode(flat).alias("pos", "val")).select(*names, (F.col("pos") + 1).cast("long").alias("pos"), "val")
