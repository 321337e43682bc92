"""Chat formatting: records of many layouts to turns by schema fingerprints, and turns to text with a loss mask.

A record is a VARIANT.  Its nested field paths, without types, are hashed to a fingerprint, and the fingerprint selects
the declared mapping (LAYOUTS) that makes the record's turns.  A mapping says for each turn, or each element of a list,
where its role and its text are; a new layout is a new entry there.

The template puts marks around each turn.  In roles and texts a backslash becomes two, and a mark gets one after its
``<``, so no mark stands in them, the text falls apart again at its marks, and what stands between is restored as it was.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.llm.common import table

#: The template's marks: before a turn, between its role and its text, and after it.
OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
END = CLOSE + "\n"
#: Fields that a record of any layout may have beside those of its turns.
ASIDE = ("id", "source")
TURNS = "array<struct<role: string, text: string>>"


class Said(NamedTuple):
    """One turn of a fixed role: the texts at these paths, blank ones left out, two line ends between them."""

    role: str
    paths: tuple[str, ...]


class One(NamedTuple):
    """One turn, its role and its text at paths of their own."""

    role: str
    text: str


class Each(NamedTuple):
    """A turn for each element of a list; roles gives other names to some roles."""

    items: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


class Layout(NamedTuple):
    """paths: what a record must have; optional: what it may have too; ``a[].b`` is field b of a list's elements."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Said | One | Each, ...]


LAYOUTS = (
    Layout("row", ("role", "text"), ("turn",), (One("role", "text"),)),
    Layout("messages", ("messages[].content", "messages[].role"), ("messages[].name",), (Each("messages", "role", "content"),)),
    Layout("from-value", ("conversations[].from", "conversations[].value"), (), (Each("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),)),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (Said("system", ("system",)), Said("user", ("instruction", "input")), Said("assistant", ("output",)))),
    Layout("prompt-response", ("prompt", "response"), ("system",), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("prompt-completion", ("completion", "prompt"), ("system",), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt-messages", ("prompt[].content", "prompt[].role", "response"), (), (Each("prompt", "role", "content"), Said("assistant", ("response",)))),
)


def field_paths(record: Column) -> Column:
    """A record's nested field names, sorted in each object, as one string; null for a null record."""
    return F.regexp_replace(F.schema_of_variant(record), r"(: |ARRAY<)[A-Z][A-Z_]*(?:\([0-9, ]*\))?(?=[,>])", "$1")


def declared_paths(paths: tuple[str, ...]) -> str:
    """The same string of declared paths."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def shown(node: dict) -> str:
        kind = lambda name, sub: f"{name.removesuffix('[]')}: " + (f"ARRAY<{shown(sub)}>" if name.endswith("[]") else shown(sub) if sub else "")
        return "OBJECT<" + ", ".join(kind(n, node[n]) for n in sorted(node, key=lambda n: n.removesuffix("[]"))) + ">" if node else ""

    return shown(tree)


def _subsets(items: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [c for k in range(len(items) + 1) for c in combinations(items, k)]


def _turns(record: Column, rule: Said | One | Each, have: set[str]) -> Column:
    """The turns that a rule makes of a record with these paths."""
    said = lambda v, path: F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if isinstance(rule, One):
        return F.array(turn(said(record, rule.role), said(record, rule.text)))
    if isinstance(rule, Said):
        texts = [said(record, p) for p in rule.paths if p in have]
        if not texts:
            return F.array().cast(TURNS)
        return F.array(turn(F.lit(rule.role), texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda t: F.trim(t) != ""), "\n\n")))
    items = F.coalesce(F.try_variant_get(record, f"$.{rule.items}", "array<variant>"), F.array().cast("array<variant>"))

    def one(v: Column) -> Column:
        role = said(v, rule.role)
        return turn(reduce(lambda otherwise, named: F.when(role == named[0], named[1]).otherwise(otherwise), rule.roles, role), said(v, rule.text))

    return F.transform(items, one)


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with ``fingerprint long, layout string, turns array<struct<role, text>>``.

    A record whose fingerprint no layout has, a null one among them, has a null layout and null turns.  A field that is
    there but null, or no scalar, is an empty text; an optional one that isn't there makes no turn.
    """
    found = records.withColumn("fingerprint", F.xxhash64(field_paths(F.col(record))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        for more in _subsets(layout.optional):
            have = (*layout.paths, *more)
            hashes = [F.xxhash64(F.lit(declared_paths((*have, *aside)))) for aside in _subsets(ASIDE)]
            is_it = F.col("fingerprint").isin(hashes)
            made = [_turns(F.col(record), rule, set(have)) for rule in layout.turns]
            name = F.when(is_it, layout.name).otherwise(name)
            turns = F.when(is_it, F.concat(*made).cast(TURNS)).otherwise(turns)
    return found.withColumns({"layout": name, "turns": turns})


def unknown_layouts(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``fingerprint, paths, n`` of the records that no layout fits, to declare one for them."""
    unknown = canonical_turns(records, record, layouts).where("layout is null")
    return unknown.groupBy("fingerprint").agg(F.min(field_paths(F.col(record))).alias("paths"), F.count("*").alias("n"))


def escaped(text: Column) -> Column:
    """The text without marks, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, SAYS, CLOSE):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, learn: str = "assistant") -> DataFrame:
    """``chat_id, formatted string, loss array<struct<turn, start, length>>`` of every chat with turns.

    records: ``chat_id, position, record``; other columns are ignored.  A chat's records follow one another by position
    (nulls first), of equal ones by the MD5 of their turns' text; repeated records are repeated turns.  Records without a
    chat_id are one chat.  loss has the turns of the role to learn: the number of the turn, and where in it (code points
    from the turn's own mark on) the escaped text stands.  Places count within turns, so reading a chat takes time in
    proportion to it.  Records of no known layout add nothing (see unknown_layouts).  An empty table has no chats.
    Turns are formatted where they are read; only then does a chat meet, as one value like a document, in one row.
    """
    made = canonical_turns(records, "record", layouts)

    def block(t: Column) -> Column:
        role, text = escaped(t["role"]), escaped(t["text"])
        is_loss = t["role"] == learn
        return F.struct(
            F.concat(F.lit(OPEN), role, F.lit(SAYS), text, F.lit(END)).alias("block"),
            F.when(is_loss, F.char_length(role) + len(OPEN) + len(SAYS)).alias("start"), F.when(is_loss, F.char_length(text)).alias("length"),
        )

    rows = made.select("chat_id", "position", F.transform("turns", block).alias("t"))
    rows = rows.withColumn("key", F.md5(F.array_join(F.transform("t", lambda x: x["block"]), "")))
    # outer, for else the optimiser tests the list's size before, and makes it twice
    rows = rows.select("chat_id", "position", "key", F.posexplode_outer("t").alias("k", "t")).where("t is not null")
    chats = rows.groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct("position", "key", "k", "t"))).alias("rows"))
    loss = F.filter(F.transform("rows", lambda x, i: F.struct(i.alias("turn"), x["t"]["start"].alias("start"), x["t"]["length"].alias("length"))), lambda x: x["start"].isNotNull())
    return chats.select("chat_id", F.array_join(F.transform("rows", lambda x: x["t"]["block"]), "").alias("formatted"), loss.alias("loss"))


def read_chats(chats: DataFrame) -> DataFrame:
    """``chat_id, turns array<struct<role, text>>, learned array<string>, formatted_chars long`` read back from format_chats' columns.

    learned: what stands under the loss mask, as it was before escaping, a text a turn of loss.
    """
    pieces = F.split("formatted", END)
    cut = chats.withColumn("blocks", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    halves = lambda b: F.split(F.substring(b, F.lit(len(OPEN) + 1), F.char_length(b)), SAYS)
    turn = lambda b: F.struct(unescaped(halves(b)[0]).alias("role"), unescaped(halves(b)[1]).alias("text"))
    under = lambda x: unescaped(F.substring(F.get("blocks", x["turn"]), x["start"] + 1, x["length"]))
    return cut.select("chat_id", F.transform("blocks", turn).alias("turns"), F.transform("loss", under).alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))


#: The contract's own conversation: what both of its rows say.
PLANTED = r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of all conversations, read back; the planted one comes in another layout than the rows."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("position"), F.to_variant_object(F.struct("role", "text")).alias("record"))
    said = F.lit(PLANTED)
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("chat_id"), F.lit(0).cast("long").alias("position"), F.to_variant_object(F.struct(said.alias("instruction"), said.alias("output"))).alias("record"))
    back = read_chats(format_chats(rows.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        F.col("chat_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars",
    )


_ESCAPED = lambda c: rf"replace(replace(replace(replace({c}, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>')"
OP13_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'
), b AS (SELECT *, concat('<turn>', {_ESCAPED("role")}, '<says>', {_ESCAPED("text")}, '</turn>', chr(10)) AS block FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, md5(block))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(block)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(block)) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""
