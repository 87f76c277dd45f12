"""Chat formatting by schema fingerprints; DataFrame functions only.

Records come in many layouts. The nested field paths of a record are hashed to a
fingerprint, and the fingerprint selects a declarative ``Layout`` that says
where the turns are. A typed table has one fingerprint, known when the plan is
made; a column of JSON texts has one in every row, computed from the row's own
paths. Canonical turns are ``array<struct<role string, text string>>``. They are
written by a template whose control strings, inside a role or text, are escaped
by a backslash behind their first character, backslashes themselves being
doubled; reading back undoes it exactly.

Defined results: a null role or text is empty; turns of one conversation are
taken by turn, ties by role and text, null turns first; repeated rows are
repeated turns; a record of an unknown layout has no turns and a null layout; a
conversation without turns is the empty string; an empty table gives an empty
result. Columns that no layout names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns: an array with a role and a text field, or fixed fields with fixed roles."""

    name: str
    array: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()  # (path, role)
    joined: tuple[str, str] | None = None  # a second field that goes below the first

    @property
    def paths(self) -> list[str]:
        own = [p for p, _ in self.fields] + ([self.joined[1]] if self.joined else [])
        if self.array is not None:
            own += [f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"]
        elif self.role:
            own += ["turn", self.role, self.text]
        return own


#: Role names of the layouts and the canonical role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("turn_rows", role="role", text="text"),
    Layout("messages", array="messages", role="role", text="content"),
    Layout("share", array="conversations", role="from", text="value"),
    Layout("prompt_completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("instruction_input", fields=(("instruction", "user"), ("output", "assistant")), joined=("instruction", "input")),
    Layout("instruction", fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("question_answer", fields=(("question", "user"), ("answer", "assistant"))),
)


def fingerprint(paths: list[str]) -> int:
    """XXH64 of the sorted nested field paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)), 42)


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def canonical_role(role: Column) -> Column:
    known = F.lower(F.trim(role))
    found = F.coalesce(role, F.lit(""))
    for name, canonical in ROLES.items():
        found = F.when(known == name, canonical).otherwise(found)
    return found


def _turn(role: Column, text: Column) -> Column:
    return F.struct(canonical_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_of(record, layout: Layout) -> Column:
    """Canonical turns of one record; ``record(path)`` gives a column."""
    if layout.array:
        return F.coalesce(F.transform(record(layout.array), lambda t: _turn(t[layout.role], t[layout.text])), F.array().cast(TURNS))
    texts = {p: F.coalesce(record(p), F.lit("")) for p, _ in layout.fields}
    if layout.joined:
        head, tail = layout.joined
        more = F.coalesce(record(tail), F.lit(""))
        texts[head] = F.when(more == "", texts[head]).otherwise(F.concat(texts[head], F.lit("\n\n"), more))
    return F.array(*(F.struct(F.lit(role).alias("role"), texts[p].alias("text")) for p, role in layout.fields))


def canonical_turns(table: DataFrame, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """(id, layout, turns) of a typed table. Its record is made of ``columns``, by default those that any layout names."""
    named = {p.split("[")[0] for x in LAYOUTS for p in x.paths}
    columns = [c for c in table.columns if c != id_col and c in named] if columns is None else columns
    record = T.StructType([table.schema[c] for c in columns])
    layout = BY_FINGERPRINT.get(fingerprint(field_paths(record)))
    if layout is None:
        return table.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("layout"), F.array().cast(TURNS).alias("turns"))
    if layout.name == "turn_rows":
        row = F.struct(F.col("turn").alias("turn"), canonical_role(F.col(layout.role)).alias("role"), F.coalesce(F.col(layout.text), F.lit("")).alias("text"))
        rows = table.select(F.col(id_col).alias("id"), row.alias("row")).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        turns = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
        return rows.select("id", F.lit(layout.name).alias("layout"), turns.alias("turns"))
    return table.select(F.col(id_col).alias("id"), F.lit(layout.name).alias("layout"), turns_of(F.col, layout).alias("turns"))


def canonical_json(table: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, layout, turns) of records given as JSON texts, each by its own fingerprint."""
    scalar = r": (STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\([0-9, ]+\))"

    def shape(layout: Layout) -> str:  # as schema_of_variant writes it, without scalar types
        if layout.array:
            return f"OBJECT<{layout.array}: ARRAY<OBJECT<{', '.join(sorted((layout.role, layout.text)))}>>>"
        return f"OBJECT<{', '.join(sorted(layout.paths))}>"

    layouts = [x for x in LAYOUTS if x.name != "turn_rows"]
    arrays = {x.array: f"{x.array} array<struct<`{x.role}` string, `{x.text}` string>>" for x in layouts if x.array}
    flat = dict.fromkeys(p for x in layouts if not x.array for p in x.paths)
    schema = ", ".join([*arrays.values(), *(f"{p} string" for p in flat)])
    seen = table.select(F.col(id_col).alias("id"), F.xxhash64(F.regexp_replace(F.schema_of_variant(F.try_parse_json(F.col(json_col))), scalar, "")).alias("print"), F.from_json(F.col(json_col), schema).alias("record"))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    prints = {x.name: signed(xxhash.xxh64_intdigest(shape(x), 42)) for x in layouts}
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in layouts:
        same = F.col("print") == prints[x.name]
        layout = F.when(same, x.name).otherwise(layout)
        turns = F.when(same, turns_of(lambda p: F.col(f"record.{p}"), x)).otherwise(turns)
    return seen.select("id", layout.alias("layout"), turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """A turn is written ``opens + role + ends_role + text + closes``; ``control`` are the strings to escape."""

    opens: str = "<|im_start|>"
    ends_role: str = "\n"
    closes: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.control:
            text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return text

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\\n"))

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(table: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, its runs of (chars, loss) in order; only assistants' texts bear loss."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(template.opens), template.escape_role(t["role"]), F.lit(template.ends_role)).alias("head"), template.escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    written = table.withColumn("parts", parts)
    runs = F.transform("parts", lambda p: F.array(F.struct(F.char_length(p["head"]).alias("chars"), F.lit(False).alias("loss")), F.struct(F.char_length(p["body"]).alias("chars"), p["loss"].alias("loss")), F.struct(F.lit(len(template.closes)).alias("chars"), F.lit(False).alias("loss"))))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(template.closes))), "")
    return written.select(*table.columns, text.alias("formatted"), F.flatten(runs).alias("loss_mask"))


def read_turns(table: DataFrame, template: Template = Template()) -> DataFrame:
    """(id, formatted, turns, loss): the turns as they stand in ``formatted``, and what of each lies under ``loss_mask``, unescaped.

    Every written turn takes its own three runs of the mask, so that no run is
    looked for from the start of a long conversation; a mask that does not fit
    ``formatted`` is an error.
    """
    quoted = "".join(f"\\{c}" if not c.isalnum() and c not in "_\n" else c for c in template.opens)
    head = rf"\A{quoted}((?:[^\\\n]++|\\[\s\S])*+)\n"
    pieces = F.filter(F.split(F.col("formatted"), "".join(f"\\{c}" if not c.isalnum() and c not in "_\n" else c for c in template.closes)), lambda p: p != "")
    pairs = F.transform(pieces, lambda p, k: F.struct(p.alias("piece"), F.regexp_extract(p, head, 1).alias("role"), F.slice("loss_mask", 3 * k + 1, 3).alias("runs")))
    text = lambda p: F.substring(p["piece"], F.char_length(p["role"]) + F.lit(len(template.opens) + len(template.ends_role) + 1), F.char_length(p["piece"]))
    turns = F.transform("pairs", lambda p: F.struct(template.unescape(p["role"]).alias("role"), template.unescape(text(p)).alias("text")))

    def under_mask(p):
        written, at, found = F.concat(p["piece"], F.lit(template.closes)), F.lit(0), []
        for k in range(3):
            run = F.get(p["runs"], k)
            found.append(F.when(run["loss"], F.substring(written, at + 1, run["chars"])).otherwise(""))
            at = at + run["chars"]
        fits = F.coalesce(at == F.char_length(written), F.lit(False))
        return F.when(fits, template.unescape(F.concat(*found))).otherwise(F.raise_error(F.lit("the loss mask does not fit the formatted text")))

    read = table.select("id", "formatted", "loss_mask", pairs.alias("pairs"))
    whole = F.when(F.size("loss_mask") == 3 * F.size("pairs"), F.transform("pairs", under_mask)).otherwise(F.raise_error(F.lit("the loss mask does not fit the formatted text")))
    return read.select("id", "formatted", turns.alias("turns"), whole.alias("loss"))


def digests(read: DataFrame, id_col: str) -> DataFrame:
    """Counts and digests of what ``read_turns`` found; loss is what lies under the mask, whatever the roles say."""
    loss = F.array_join("loss", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("id").alias(id_col), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def oracle(template: Template = Template()) -> str:
    """DuckDB SQL of the query over ``conversations`` and conversation -1."""

    def escaped(column: str) -> str:
        sql = f"replace({column}, '\\', '\\\\')"
        for c in template.control:
            sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
        return sql

    role = "coalesce(" + "CASE lower(trim(role)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items()) + " ELSE role END, '')"
    head = len(template.opens) + len(template.ends_role) + len(template.closes)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, {role} AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({head} + length({escaped('role')}) + length(role) - length(replace(role, chr(10), '')) + length({escaped('text')})) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said
"""
