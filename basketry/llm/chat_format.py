"""Chat conversations as budgeted, turn-aligned windows of marked text with a loss mask.

A turn is written ``### role: text</turn>`` and a line feed. Inside texts and roles the three
control strings are escaped, and so is the escape sign, which makes the writing reversible:

    \\  ->  \\s        ###  ->  \\h        </turn>  ->  \\e        : (in roles)  ->  \\c

Prefix sums of the turns' tokens choose the spans. With room for C tokens in a cell, a turn goes to
the cell in which its last token falls; the turns of a cell make one window. A turn longer than a
cell stands alone. A window repeats the conversation's leading system turn and, of the window
before, the last turns within ``history`` tokens. With C = (budget - history - system) / 2 no
window exceeds the budget, unless a turn is longer than two cells or the system turn takes all the
room: turns are never cut. Assistant texts are targets once: in repeated turns they are masked.

All is DataFrame functions. Turns are ordered by windows over the conversation, which spill; what
is gathered in one row is never more than two neighbouring windows' turns.

Defined results: null text or role is empty; turns are ordered by turn (null first), then role and
text, so repeated rows are turns of their own; a null conversation id is one conversation; an
empty table has no windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN, END = "### ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """Text without control strings."""
    for plain, coded in (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), *(((":", "\\c"),) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """What escape() was given."""
    for plain, coded in ((":", "\\c"), ("</turn>", "\\e"), ("###", "\\h"), ("\\", "\\s")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def estimated_tokens(role: Column, text: Column) -> Column:
    """Tokens of a turn without a tokenizer: one for four characters, and four for the marks."""
    return F.ceil((F.length(role) + F.length(text)) / 4).cast("long") + 4


def windows(turns: DataFrame, budget: int = 1024, history: int = 128, tokens_col: str | None = None) -> DataFrame:
    """One row per window.

    conv_id, window (from 0), n_repeated (turns at the window's begin that an earlier one has),
    n_turns (the others), n_tokens, formatted (the text), loss (array of start, length in
    characters of formatted, from 0).
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    tokens = F.col(tokens_col).cast("long") if tokens_col else estimated_tokens(role, text)
    rows = turns.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.greatest(F.lit(1), tokens).alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("next", F.lead("pos").over(order))
    lead = F.col("pos").__eq__(1) & (F.col("role") == "system")
    mark = F.struct("pos", "role", "text", "n", F.lit(0).cast("long").alias("begin"))
    rows = rows.withColumn("system", F.first(F.when(lead, mark), ignorenulls=True).over(running))
    # the system turn takes no room of its own in the cells; alone in its conversation it is a window
    rows = rows.withColumn("own", F.when(lead, F.lit(0)).otherwise(F.col("n"))).withColumn("upto", F.sum("own").over(running))
    room = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.coalesce(F.col("system.n"), F.lit(0))) / 2))
    cell = 2 * F.floor(F.greatest(F.lit(0), F.col("upto") - 1) / room) + F.when(F.col("own") <= room, 1).otherwise(0)
    rows = rows.filter(~(lead & F.col("next").isNotNull())).withColumn("cell", cell).withColumn("begin", F.col("upto") - F.col("own"))
    told = F.struct("pos", "role", "text", "n", "begin")
    cells = rows.groupBy("conv_id", "cell").agg(F.array_sort(F.collect_list(told)).alias("turns"), F.first("system").alias("system"))
    by_cell = Window.partitionBy("conv_id").orderBy("cell")
    cells = cells.withColumn("before", F.lag("turns").over(by_cell)).withColumn("window", F.row_number().over(by_cell) - 1)
    start = F.col("turns")[0]["begin"]
    repeated = F.filter(F.coalesce(F.col("before"), F.array().cast(cells.schema["turns"].dataType)), lambda t: start - t["begin"] <= history)
    opening = F.when(F.col("system").isNotNull() & (F.col("turns")[0]["pos"] != 1), F.array("system")).otherwise(F.array().cast(cells.schema["turns"].dataType))
    cells = cells.withColumn("opening", opening).withColumn("again", repeated)
    # the first window has the system turn as its own
    old = F.when(F.col("window") == 0, F.lit(0)).otherwise(F.size("opening")) + F.size("again")
    cells = cells.select("conv_id", "window", old.alias("n_repeated"), F.concat("opening", "again", "turns").alias("all"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"], role=True), F.lit(": "))
    parts = F.transform("all", lambda t, i: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), ((t["role"] == "assistant") & (i >= F.col("n_repeated"))).alias("target"), t["n"].alias("n")))
    cells = cells.select("conv_id", "window", "n_repeated", parts.alias("parts"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    begins = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, q: a + size(q)))
    spans = F.zip_with("parts", begins, lambda p, b: F.struct(p["target"].alias("target"), (b + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))
    loss = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    n_tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return cells.select("conv_id", "window", "n_repeated", (F.size("parts") - F.col("n_repeated")).alias("n_turns"), n_tokens.alias("n_tokens"), formatted.alias("formatted"), loss.alias("loss"))


def parsed(formatted: Column) -> Column:
    """The turns of a window's text: array of role, text."""
    pieces = F.split(formatted, END.replace("/", "\\/"), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        cut = F.instr(p, ": ")
        return F.struct(unescape(F.substring(p, F.lit(len(TURN) + 1), cut - len(TURN) - 1)).alias("role"), unescape(F.substring(p, cut + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from windows() output alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Here a conversation's
    whole text meets in one row, as its digest asks.
    """
    fresh = F.slice(parsed(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_turns"))
    told = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    rows = formatted.select("conv_id", "window", "n_turns", F.length("formatted").alias("chars"), told.alias("told"), learned.alias("learned"))
    rows = rows.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "told", "learned"))).alias("all"))
    rows = rows.withColumn("told", F.array_join("all.told", "")).withColumn("learned", F.array_join("all.learned", ""))
    return rows.select("conv_id", F.col("n_turns").cast("long"), F.sha2("told", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


def oracle(turns: str, budget: int = 1024, history: int = 128) -> str:
    """DuckDB SQL for read_back(windows(turns)), from the turns themselves; ``turns`` is a table expression."""
    esc = "replace(replace(replace({0}, '\\', '\\s'), '###', '\\h'), '</turn>', '\\e')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {turns}),
o AS (SELECT *, CAST(ceil((length(role) + length(text)) / 4) AS BIGINT) + 4 AS n,
             length('### ') + length(replace({esc.format('role')}, ':', '\\c')) + 2 + length({esc.format('text')}) + length('</turn>') + 1 AS chars,
             row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS turns
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, pos = 1 AND role = 'system' AS lead FROM o),
s AS (SELECT *, max(CASE WHEN lead THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_n,
             max(CASE WHEN lead THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars,
             CASE WHEN lead THEN 0 ELSE n END AS own FROM m),
u AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY pos) AS upto,
             greatest(1, floor(({budget - history} - sys_n) / 2)) AS room FROM s),
c AS (SELECT *, upto - own AS start, 2 * floor(greatest(0, upto - 1) / room) + (CASE WHEN own <= room THEN 1 ELSE 0 END) AS cell
      FROM u WHERE NOT (lead AND turns > 1)),
d AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY cell) - 1 AS win, min(start) OVER (PARTITION BY conv_id, cell) AS begin FROM c),
b AS (SELECT DISTINCT conv_id, win, begin FROM d),
h AS (SELECT d.conv_id, sum(d.chars) AS chars FROM d JOIN b ON b.conv_id IS NOT DISTINCT FROM d.conv_id AND b.win = d.win + 1 WHERE b.begin - d.start <= {history} GROUP BY 1),
f AS (SELECT conv_id, sum(chars) + max(CASE WHEN turns > 1 THEN sys_chars ELSE 0 END) * (max(win) + 1) AS chars FROM d GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned FROM o GROUP BY 1)
SELECT a.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(f.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars
FROM a JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id"""
