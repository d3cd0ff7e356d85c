"""Chat formatting from event logs: messages are folded from their events, then rendered with a template that can be read back.

A log has one row an event: `message` opens a message, `delta` adds to its text, `edit` puts another text in its place, `regenerate` empties it and takes
back whatever was opened after it. Events of one message are folded together, so a conversation of any length is dealt out message by message; which
messages were taken back follows from a running maximum over spans of the log. Only rendered messages of a conversation meet, as the
text of a conversation is one value (2 GB at most).

The template: an assistant's turn is `<s>text</s>`, any other `[INST]role\\ntext[/INST]`. Control strings inside texts and roles get a backslash behind
their first character (one more where backslashes stand there already), which reading takes away again. A control string has an
opening bracket only at its start and a closing one only at its end, so none arises where texts and marks meet.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
START, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
# An opening bracket with its backslashes before the rest of a control string; the same with one backslash more.
_PLAIN = r"(<\\*)(?=/?s>)|(\[\\*)(?=/?INST\])"
_ESCAPED = r"(<\\*)\\(?=/?s>)|(\[\\*)\\(?=/?INST\])"
# Kinds of events in the order in which those of one sequence number apply.
KINDS = ("message", "regenerate", "edit", "delta")
# Sequence numbers (or times) that agree but for so many low bits are looked at together when what was taken back is sought.
SPAN_BITS = 12


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Whole messages, one a row of (conv_id, turn, role, text), as a log. Rows that share a turn are messages of their own."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("msg"), F.lit("message").alias("kind"),
        F.col("role").alias("role"), F.col("text").alias("text"),
    )


def _fold(events: Column) -> Column:
    """Messages (opened, role, text pieces) of the sorted events of one message number.

    Each `message` event opens another; later events belong to the last one opened, those before the first open one themselves.
    """
    kind, role, text = (lambda e: e["kind"]), (lambda e: F.coalesce(e["role"], F.lit(""))), (lambda e: F.coalesce(e["text"], F.lit("")))
    starts = F.filter(F.transform(events, lambda e, i: F.when((i == 0) | (kind(e) == 0), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    runs = F.transform(starts, lambda start, k: F.slice(events, start + 1, F.coalesce(F.get(starts, k + 1), F.size(events)) - start))

    def message(run: Column) -> Column:
        # Only what follows the last event that sets the text anew counts.
        fresh = F.array_max(F.transform(run, lambda e, i: F.when(kind(e) < 3, i).otherwise(F.lit(0))))
        pieces = F.transform(F.slice(run, fresh + 1, F.size(run)), lambda e: F.when(kind(e) == 1, F.lit("")).otherwise(text(e)))
        return F.struct(run[0]["seq"].alias("opened"), role(run[0]).alias("role"), F.concat_ws("", pieces).alias("text"))

    return F.transform(runs, message)


def _taken_back(events: DataFrame) -> DataFrame:
    """conv_id, opened: the opening numbers of messages that a later `regenerate` of an earlier message takes back.

    A message opened at s is gone if some message opened before s is regenerated after s: if the latest regeneration of all messages opened before s lies
    behind s. The running maximum is taken within spans of sequence numbers and over the spans, so that no task holds a whole long conversation.
    Logs without regenerations (known from the plan or found at run time) cost nothing here.
    """
    again = events.where("kind = 'regenerate'")
    with_some = again.select(F.col("conv_id").alias("some")).distinct()
    marks = events.where("seq IS NOT NULL").select("conv_id", "msg", "seq", "kind").join(with_some, F.col("conv_id").eqNullSafe(F.col("some")), "left_semi")
    opens, agains = (F.collect_set(F.when(F.col("kind") == kind, F.col("seq"))) for kind in ("message", "regenerate"))
    per = marks.groupBy("conv_id", "msg").agg(F.sort_array(F.array_union(opens, F.array(F.min("seq")))).alias("opens"), agains.alias("agains"))
    # Regenerations between an opening of the message and its next one belong to the first.
    each = F.transform("opens", lambda s, k: F.struct(s.alias("opened"), F.get("opens", k + 1).alias("until")))
    opened = per.select("conv_id", "agains", F.explode(each).alias("o")).select("conv_id", "agains", "o.opened", "o.until")
    own = F.array_max(F.filter("agains", lambda s: (s >= F.col("opened")) & (F.col("until").isNull() | (s < F.col("until")))))
    opened = opened.groupBy("conv_id", "opened").agg(F.max(own).alias("again")).withColumn("span", F.shiftright("opened", SPAN_BITS))
    spans = opened.groupBy("conv_id", "span").agg(F.max("again").alias("again"))
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    spans = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.expr(f"max(again) OVER (PARTITION BY conv_id ORDER BY span {before})").alias("earlier"))
    within = opened.select("conv_id", "span", "opened", F.expr(f"max(again) OVER (PARTITION BY conv_id, span ORDER BY opened {before})").alias("latest"))
    both = within.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")))
    return both.where(F.greatest("latest", "earlier") > F.col("opened")).select("conv_id", "opened")


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, opened, msg, nth, role, text of every message that stands at the end of the log (conv_id, seq, msg, kind, role, text).

    Events apply by seq, then in the order of KINDS, then by role and text (bytes). Events of a null seq come first; they neither take back nor are taken back. Null text
    and role are empty; the role is that of the opening event. Two `message` events of one number make two messages (repeated rows too). A message that only later
    events name is opened by the first of them. A regeneration takes back what was opened behind its message and before itself, even where its message is gone as well.
    A null conversation or number is one of its own. Other kinds and null kinds are an error. Extra columns are ignored; an empty log gives no messages.
    """
    known = F.col("kind").isin(*KINDS)
    rows = events.select(
        F.col("conv_id").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("msg").cast("long").alias("msg"),
        F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(F.col("kind"), F.lit("null"))))).alias("kind"), F.col("role").alias("role"), F.col("text").alias("text"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    folded = rows.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", place.cast("int").alias("kind"), "role", "text"))).alias("events"))
    messages = folded.select("conv_id", "msg", F.posexplode(_fold(F.col("events"))).alias("nth", "m")).select("conv_id", "m.opened", "msg", "nth", "m.role", "m.text")
    gone = _taken_back(rows).select(F.col("conv_id").alias("c"), F.col("opened").alias("o"))
    return messages.join(gone, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("opened") == F.col("o")), "left_anti")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_messages, segments (text, loss) in order: strung together they are the formatted conversation; the loss mask covers assistants' texts only.

    Messages come in order of opening, ties by number, then as they were opened. The text of a conversation must fit one value.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    assistant = role == ASSISTANT
    head = F.when(assistant, F.lit(START)).otherwise(F.concat(F.lit(OPEN), escape(_one_line(role)), F.lit("\n")))
    shown = messages.select("conv_id", "opened", "msg", "nth", head.alias("head"), escape(text).alias("body"), assistant.alias("loss"))
    rows = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("opened", "msg", "nth", "head", "body", "loss"))).alias("rows"))

    def segments(r: Column) -> Column:
        tail = F.when(r["loss"], F.lit(END)).otherwise(F.lit(CLOSE))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(r["head"], F.lit(False)), piece(r["body"], r["loss"]), piece(tail, F.lit(False)))

    return rows.select("conv_id", F.size("rows").alias("n_messages"), F.flatten(F.transform("rows", segments)).alias("segments"))


def _one_line(role: Column) -> Column:
    """A role without line ends, so that the first line end behind a mark ends it: backslashes are doubled, line ends become `\\n`."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _lines_back(role: Column) -> Column:
    halves = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(halves, "\\")


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def turns(text: Column) -> Column:
    """Array of (role, text) read back from formatted text alone."""
    pieces = F.filter(F.split(text, r"</s>|\[/INST\]", -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        assistant = F.startswith(piece, F.lit(START))
        cut = F.locate("\n", piece)
        return F.struct(
            F.when(assistant, F.lit(ASSISTANT)).otherwise(_lines_back(unescape(F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)))).alias("role"),
            unescape(F.when(assistant, F.substring(piece, F.lit(len(START) + 1), F.length(piece))).otherwise(F.substring(piece, cut + 1, F.length(piece)))).alias("text"))

    return F.transform(pieces, turn)


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendered conversations."""
    text = rendered.select("conv_id", formatted(F.col("segments")).alias("whole"), F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))).alias("learned"))
    read = text.select("conv_id", "learned", F.length("whole").alias("chars"), turns(F.col("whole")).alias("turns"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"))


# For DuckDB: what the digests are by the turns themselves, and the lengths by counting control strings.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS body,
    length(replace(replace(role, '\', '\\'), chr(10), '\n')) + len(regexp_extract_all(replace(replace(role, '\', '\\'), chr(10), '\n'), '<\\*/?s>|\[\\*/?INST\]')) AS name
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + name END) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
