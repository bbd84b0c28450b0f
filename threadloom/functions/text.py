"""Text scrubbing and formatting as Column expressions.

Java's regex defaults are narrower than the Unicode rules the data was defined with, so
every pattern carries the flags ``d`` (only ``\\n`` ends a line) and ``U`` (Unicode classes),
and white space also counts the separators U+001C to U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.config import ChatConfig

# Patterns that decide what is removed.
FLAGS = "(?dU)"
SPACE = r"\s\x1c-\x1f"
URL = rf"{FLAGS}(?:http|www)[^{SPACE}]+"
EMOJI = rf"{FLAGS}<.+?:\d+>"
MENTION = rf"{FLAGS}<[#@].*?(\d+?)>"
MENTION_END = rf"{FLAGS}\d>"
MENTION_OF_ID = (rf"{FLAGS}<[#@].*?", ">")
BLANKS = rf"[{SPACE}&&[^\n]]"
# A single plain blank stays as it is, so it need not match.
SPACE_RUN = rf"{FLAGS}[{SPACE}&&[^\n ]]{BLANKS}*+| {BLANKS}++"
MANY_IDS = 32  # so many different ids of different lengths are compared in pairs
# All white space there is, for trimming.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip_urls(text: Column) -> Column:
    # Most text has no link; the plain search spares it the pattern.
    may_match = text.contains("http") | text.contains("www")
    return F.when(may_match, F.regexp_replace(text, URL, "")).otherwise(text)


def strip_emoji(text: Column) -> Column:
    return F.when(text.contains("<"), F.regexp_replace(text, EMOJI, "")).otherwise(text)


def mention_ids(text: Column) -> Column:
    """Ids of all mentions in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def _literal_replacement(name: Column) -> Column:
    """Escape what a Java replacement string would read as a group reference."""
    return F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _named(names: Column, mention: Column) -> Column:
    return F.coalesce(F.try_element_at(names, mention), F.lit(""))


def _fold_ids(text: Column, ids: Column, names: Column) -> Column:
    """Id by id in order, each step acting on the result of the step before and on every mention that
    ends in the id. The pattern depends on the row."""
    before, after = MENTION_OF_ID

    def one_id(current: Column, mention: Column) -> Column:
        pattern = F.concat(F.lit(before), mention, F.lit(after))
        return F.regexp_replace(current, pattern, _literal_replacement(_named(names, mention)))

    return F.aggregate(ids, text, one_id)


def _replace_at_once(text: Column, ids: Column, names: Column) -> Column:
    """What stands between the mentions, joined again by the names."""
    # Split leaves one part more than there are mentions; nothing follows the last.
    parts = F.split(text, MENTION, -1)
    return F.array_join(F.zip_with(parts, ids, lambda part, mention: F.concat(part, _named(names, mention))), "")


def untangled(text: Column, ids: Column, names: Column) -> Column:
    """Whether no step of the fold can reach beyond the mentions of its own id.

    A step for an id reaches from the start of a mention to the next place where the id stands before
    ``>``. So it stays inside if all digits before ``>`` are those of mentions, no id comes back after
    another one or is the end of another one, and no replacement makes the start or end of a mention.
    """
    different = F.array_distinct(ids)
    first_of_run = F.filter(ids, lambda x, i: (i == 0) | (x != F.get(ids, i - 1)))
    lengths = F.transform(different, F.length)
    some_end = F.exists(different, lambda a: F.exists(different, lambda b: (a != b) & b.endswith(a)))
    apart = (F.array_min(lengths) == F.array_max(lengths)) | ((F.size(different) <= MANY_IDS) & ~some_end)
    marks = F.exists(different, lambda m: _named(names, m).contains("<") | _named(names, m).contains(">"))
    return ((F.regexp_count(text, F.lit(MENTION_END)) == F.size(ids)) & (F.size(first_of_run) == F.size(different))
            & apart & ~text.contains("<<") & ~marks)


def replace_ids(text: Column, ids: Column, names: Column) -> Column:
    """Swap the mentions of ``ids`` for names; unlisted ids are removed.

    By definition this goes id by id, see ``_fold_ids``, and the outcome depends on the order. Where
    mentions do not reach into each other, which is the rule, one pass with fixed patterns gives the same.
    """
    some = F.size(ids) > 0
    return (F.when(some & untangled(text, ids, names), _replace_at_once(text, ids, names))
            .when(some, _fold_ids(text, ids, names)).otherwise(text))


def replace_mentions(text: Column, names: Column) -> Column:
    return replace_ids(text, mention_ids(text), names)


def strip_ends(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def collapse_spaces(text: Column) -> Column:
    """One blank per run of white space, newlines kept, both ends stripped."""
    return strip_ends(F.regexp_replace(text, SPACE_RUN, " "))


def blanked_for_training(text: Column, author: Column, cfg: ChatConfig) -> Column:
    """True for commands and for what the bot wrote."""
    return text.startswith(cfg.command) | (author == F.lit(cfg.bot_id))


def as_impersonated(text: Column, cfg: ChatConfig) -> Column:
    """Live text with the bot's id read as the impersonated member, and the command removed."""
    swapped = F.replace(text, F.lit(str(cfg.bot_id)), F.lit(str(cfg.user_id)))
    command = cfg.command + " "
    return F.when(
        swapped.startswith(command),
        strip_ends(F.substr(swapped, F.lit(len(command) + 1))),
    ).otherwise(swapped)


def chosen_text(text: Column, author: Column, cfg: ChatConfig, training: bool) -> Column:
    """The text to scrub: commands and bot text blanked (training) or rewritten (live)."""
    if not training:
        return as_impersonated(text, cfg)
    return F.when(blanked_for_training(text, author, cfg), F.lit("")).otherwise(text)


def names_map(names: dict[str, str]) -> Column:
    if not names:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.create_map(*[F.lit(part) for pair in names.items() for part in pair])


def author_name(author: Column, listed: Column, cfg: ChatConfig, training: bool) -> Column:
    """Display name of an author; ``listed`` is the name found for the author id, if any."""
    own = F.lit(cfg.bot_label if training else cfg.user_name)
    if cfg.on_missing_name == "error":
        listed = F.coalesce(
            listed, F.raise_error(F.concat(F.lit("no name for author "), author.cast("string"))).cast("string"))
    elif cfg.on_missing_name == "id":
        listed = F.coalesce(listed, author.cast("string"))
    return F.when(author == F.lit(cfg.bot_id), own).otherwise(listed)


def format_line(name: Column, text: Column) -> Column:
    """``Name: text``; null when there is no name."""
    return F.concat(name, F.lit(": "), text)
