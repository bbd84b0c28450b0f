"""The same questions as plain SQL over the given tables."""

from __future__ import annotations

from threadloom.functions.prompts import INPUT_HEADER, INSTRUCTION_HEADER, RESPONSE_HEADER
from threadloom.plans.fixture import CFG, CONTENT, ROLE_CFG, SPLIT

# The figures of registry.py, as SQL text.
BUSY = "INTERVAL 30 HOURS"
GAP = "INTERVAL 8 HOURS"
SPLIT_AT = f"TIMESTAMP '{SPLIT:%Y-%m-%d}'"

MESSAGES = f"""
c AS (
  SELECT event_id, ts, event_type, user_id AS channelid,
         lag(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS third
  FROM events),
messages AS (
  SELECT event_id AS messageid, channelid, concat('ch', channelid) AS channelname,
         1 + (event_id % 11) % 4 AS userid, concat('u', 1 + (event_id % 11) % 4) AS username,
         ts AS sent, {CONTENT} AS content,
         CASE WHEN event_id % 7 = 0 THEN third END AS replyid,
         CAST(-1 AS BIGINT) AS conversid, true AS isFirstInConvers
  FROM c)"""

CHANNELS = """
channels AS (
  SELECT -c_custkey AS ordinal, c_custkey AS channelid FROM customer WHERE c_mktsegment = 'BUILDING')"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def name_of(id_text: str) -> str:
    cases = " ".join(f"WHEN {quoted(i)} THEN {quoted(n)}" for i, n in CFG.names.items())
    return f"(CASE {id_text} {cases} END)"


# Text

def urls(t):
    return rf"regexp_replace({t}, '(http|www)\S+', '', 'g')"


def emoji(t):
    return rf"regexp_replace({t}, '<.+?:\d+>', '', 'g')"


def ids(t):
    return rf"regexp_extract_all({t}, '<[#@].*?(\d+?)>', 1)"


def mentions(t):
    step = f"regexp_replace(t, '<[#@].*?' || id || '>', coalesce({name_of('id')}, ''), 'g')"
    return f"list_reduce({ids(t)}, lambda t, id: {step}, {t})"


def ends(t):
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def spaces(t):
    return ends(rf"regexp_replace({t}, '[^\S\n]+', ' ', 'g')")


def live(t):
    swapped = f"replace({t}, '{CFG.bot_id}', '{CFG.user_id}')"
    return f"CASE WHEN starts_with({swapped}, '/kc ') THEN {ends(f'substr({swapped}, 5)')} ELSE {swapped} END"


def cleaned(training: bool, source: str = "messages") -> str:
    """CTEs ending in ``clean``: the source's rows with scrubbed content."""
    content = "content" if training else live("content")
    result = spaces(mentions("stripped"))
    if training:
        result = (f"CASE WHEN starts_with(content, '/kc') OR userid = {CFG.bot_id} THEN '' ELSE {result} END")
    return f"""
stripped AS (SELECT *, {emoji(urls(content))} AS stripped FROM {source}),
clean AS (SELECT * EXCLUDE (content, stripped), {result} AS content FROM stripped)"""


def live_line() -> str:
    return (f"CASE WHEN content <> '' THEN concat(CASE WHEN userid = {CFG.bot_id} THEN {quoted(CFG.user_name)} "
            f"ELSE {name_of('CAST(userid AS VARCHAR)')} END, ': ', content) END")


# Conversations

def assigned(source: str, tag: str = "", first: str = "0", prior: str | None = None) -> str:
    """CTEs ending in ``assigned{tag}``: conversations of ``source`` by walking each channel.

    ``prior`` names assigned rows that come before; each channel's last one seeds its walk.
    """
    known = f"SELECT messageid, channelid, sent FROM {source}"
    seed = "SELECT NULL AS channelid, NULL AS userid, NULL AS sent, NULL AS messageid WHERE false"
    prior_roots = prior_target = ""
    if prior:
        known += f" UNION ALL SELECT messageid, channelid, sent FROM {prior}"
        seed = f"""SELECT channelid, userid, sent, messageid FROM {prior}
          QUALIFY row_number() OVER (PARTITION BY channelid ORDER BY sent DESC, messageid DESC) = 1"""
        prior_roots = f"UNION ALL SELECT messageid AS head, conversid FROM {prior}"
        prior_target = f"UNION ALL SELECT messageid, messageid AS head FROM {prior}"
    anchor = "CASE WHEN m.userid <> s.userid THEN s.sent ELSE s.anchor END"
    brk = f"(m.target IS NULL AND {anchor} < m.sent - {GAP})"
    return f"""
known{tag} AS ({known}),
seed{tag} AS ({seed}),
ranked{tag} AS (
  SELECT s.messageid, s.channelid, s.userid, s.sent, t.messageid AS target,
         row_number() OVER (PARTITION BY s.channelid ORDER BY s.sent, s.messageid) AS rn
  FROM {source} s LEFT JOIN known{tag} t
    ON t.messageid = s.replyid AND t.channelid = s.channelid
   AND (t.sent < s.sent OR (t.sent = s.sent AND t.messageid < s.messageid))),
walk{tag} AS (
  SELECT m.messageid, m.channelid, m.userid, m.sent, m.target, m.rn,
         (p.sent IS NULL OR (m.target IS NULL AND p.sent < m.sent - {GAP})) AS is_break,
         CASE WHEN p.sent IS NULL OR (m.target IS NULL AND p.sent < m.sent - {GAP})
              THEN m.sent ELSE p.sent END AS anchor,
         CASE WHEN p.sent IS NULL OR m.target IS NOT NULL OR p.sent < m.sent - {GAP}
              THEN m.messageid ELSE p.messageid END AS head
  FROM ranked{tag} m LEFT JOIN seed{tag} p USING (channelid) WHERE m.rn = 1
  UNION ALL
  SELECT m.messageid, m.channelid, m.userid, m.sent, m.target, m.rn, {brk},
         CASE WHEN {brk} THEN m.sent ELSE {anchor} END,
         CASE WHEN {brk} OR m.target IS NOT NULL THEN m.messageid ELSE s.head END
  FROM walk{tag} s JOIN ranked{tag} m ON m.channelid = s.channelid AND m.rn = s.rn + 1),
links{tag} AS (
  SELECT w.messageid AS head, t.head AS parent
  FROM walk{tag} w JOIN (SELECT messageid, head FROM walk{tag} {prior_target}) t ON t.messageid = w.target
  WHERE NOT w.is_break),
roots{tag} AS (
  SELECT * FROM (
    SELECT messageid AS head,
           {first} + row_number() OVER (ORDER BY channelid, sent, messageid) - 1 AS conversid
    FROM walk{tag} WHERE is_break {prior_roots})
  UNION ALL
  SELECT l.head, r.conversid FROM roots{tag} r JOIN links{tag} l ON l.parent = r.head),
assigned{tag} AS (
  SELECT w.messageid, w.channelid, CAST(r.conversid AS BIGINT) AS conversid, w.is_break AS isFirstInConvers
  FROM walk{tag} w JOIN roots{tag} r ON r.head = w.head)"""


def with_assigned(source: str = "messages", tag: str = "") -> str:
    return f"""{assigned(source, tag)},
joined{tag} AS (
  SELECT m.* EXCLUDE (conversid, isFirstInConvers), a.conversid, a.isFirstInConvers
  FROM {source} m JOIN assigned{tag} a USING (messageid))"""


def assign_over(tag: str, old: str | None, new: str) -> str:
    """Table stored{tag} of (old rows and) new ones with conversations; old rows keep theirs and stand
    anywhere in time among the new ones."""
    columns = "messageid, channelid, userid, sent, replyid"
    kept = f"UNION ALL SELECT {columns}, conversid AS known, isFirstInConvers AS opens FROM {old}" if old else ""
    anchor = "CASE WHEN s.known IS NOT NULL OR m.userid <> s.userid THEN s.sent ELSE s.anchor END"
    brk = f"(m.known IS NULL AND m.target IS NULL AND {anchor} < m.sent - {GAP})"
    return f"""
every{tag} AS (SELECT {columns}, NULL::BIGINT AS known, NULL::BOOLEAN AS opens FROM {new} {kept}),
ranked{tag} AS (
  SELECT s.*, t.messageid AS target, row_number() OVER (PARTITION BY s.channelid ORDER BY s.sent, s.messageid) AS rn
  FROM every{tag} s LEFT JOIN every{tag} t ON t.messageid = s.replyid AND t.channelid = s.channelid
   AND (t.sent < s.sent OR (t.sent = s.sent AND t.messageid < s.messageid))),
walk{tag} AS (
  SELECT messageid, channelid, userid, sent, known, target, rn, known IS NULL AS is_break, sent AS anchor, messageid AS head
  FROM ranked{tag} WHERE rn = 1
  UNION ALL
  SELECT m.messageid, m.channelid, m.userid, m.sent, m.known, m.target, m.rn, {brk},
         CASE WHEN m.known IS NOT NULL OR {brk} THEN m.sent ELSE {anchor} END,
         CASE WHEN m.known IS NOT NULL OR {brk} OR m.target IS NOT NULL THEN m.messageid ELSE s.head END
  FROM walk{tag} s JOIN ranked{tag} m ON m.channelid = s.channelid AND m.rn = s.rn + 1),
roots{tag} AS (
  SELECT messageid AS head, known AS conversid FROM walk{tag} WHERE known IS NOT NULL
  UNION ALL
  SELECT messageid, (SELECT coalesce(max(known), -1) FROM every{tag}) + row_number() OVER (ORDER BY channelid, sent, messageid)
  FROM walk{tag} WHERE is_break),
links{tag} AS (
  SELECT w.messageid AS head, t.head AS parent FROM walk{tag} w JOIN walk{tag} t ON t.messageid = w.target
  WHERE NOT w.is_break AND w.known IS NULL),
heads{tag} AS (
  SELECT head, conversid FROM roots{tag}
  UNION ALL
  SELECT l.head, h.conversid FROM heads{tag} h JOIN links{tag} l ON l.parent = h.head),
stored{tag} AS (
  SELECT e.* EXCLUDE (known, opens), CAST(h.conversid AS BIGINT) AS conversid, coalesce(e.opens, w.is_break) AS isFirstInConvers
  FROM every{tag} e JOIN walk{tag} w USING (messageid) JOIN heads{tag} h ON h.head = w.head)"""


HISTORY = "PARTITION BY conversid ORDER BY sent, messageid ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"


def example_rows(source: str, names: str, instruction: str, user: int) -> str:
    return f"""
framed AS (
  SELECT *, list_filter(list(CASE WHEN content <> '' THEN concat({names}, ': ', content) END)
                          OVER ({HISTORY}), lambda x: x IS NOT NULL) AS history
  FROM {source}),
examples AS (
  SELECT conversid, messageid, {quoted(instruction)} AS instruction,
         array_to_string(history, chr(10)) AS input, content AS output
  FROM framed
  WHERE userid = {user} AND content <> '' AND NOT isFirstInConvers AND len(history) > 0)"""


EXAMPLES = f"""{MESSAGES}, {with_assigned()}, {cleaned(True, 'joined')},
{example_rows('clean', name_of('CAST(userid AS VARCHAR)'), CFG.instruction_text, CFG.user_id)}"""

CONTEXT = f"""{MESSAGES}, {cleaned(False)},
lines AS (
  SELECT k.messageid, k.channelid, k.sent, m.userid <> {CFG.bot_id} AND starts_with(m.content, '/kc') AS trigger,
         {live_line().replace('content', 'k.content').replace('userid', 'k.userid')} AS line
  FROM clean k JOIN messages m USING (messageid)),
contexts AS (
  SELECT messageid, channelid, trigger, array_to_string(list_filter(list(line) OVER (
           PARTITION BY channelid ORDER BY sent, messageid ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
         lambda x: x IS NOT NULL), chr(10)) AS context
  FROM lines)"""

CONTEXT_ROWS = f"WITH {CONTEXT} SELECT messageid, channelid, context FROM contexts WHERE trigger"

TRIGGERS = (f"SELECT messageid, channelid, userid, sent, content FROM messages "
            f"WHERE userid <> {CFG.bot_id} AND starts_with(content, '/kc')")

GATE = f"""WITH RECURSIVE {MESSAGES},
t AS (SELECT *, row_number() OVER (PARTITION BY channelid ORDER BY sent, messageid) AS rn FROM ({TRIGGERS})),
walk AS (
  SELECT channelid, messageid, sent, rn, sent AS last, true AS kept FROM t WHERE rn = 1
  UNION ALL
  SELECT t.channelid, t.messageid, t.sent, t.rn,
         CASE WHEN t.sent >= w.last + {BUSY} THEN t.sent ELSE w.last END, t.sent >= w.last + {BUSY}
  FROM walk w JOIN t ON t.channelid = w.channelid AND t.rn = w.rn + 1)
SELECT channelid, messageid, sent FROM walk WHERE kept"""

INGEST = f"""{MESSAGES},
marks AS (SELECT channelid, max(sent) AS mark FROM messages WHERE sent < {SPLIT_AT} GROUP BY channelid),
fetched AS (
  SELECT m.messageid, m.channelid, m.sent
  FROM messages m LEFT JOIN marks k USING (channelid)
  WHERE k.mark IS NULL OR m.sent > k.mark
  QUALIFY row_number() OVER (PARTITION BY m.channelid ORDER BY m.sent, m.messageid) <= 5)"""

HALVES = f"""{MESSAGES},
prior_raw AS (SELECT * FROM messages WHERE sent < {SPLIT_AT}),
new_raw AS (SELECT * FROM messages WHERE sent >= {SPLIT_AT}),
{with_assigned('prior_raw', '_p')},
{assigned('new_raw', '', '(SELECT max(conversid) + 1 FROM joined_p)', 'joined_p')}"""

FOLDED = f"""WITH RECURSIVE {EXAMPLES},
numbered AS (
  SELECT messageid, row_number() OVER (ORDER BY conversid, sent, messageid) - 1 AS i, count(*) OVER () AS n
  FROM examples JOIN (SELECT messageid, sent FROM messages) USING (messageid)),
folds AS (
  SELECT CAST(k AS INTEGER) AS fold, messageid,
         CASE WHEN i >= round_even(n * k * 10 / 100.0, 0) AND i < round_even(n * (k + 1) * 10 / 100.0, 0)
              THEN 'val' ELSE 'train' END AS split
  FROM numbered, range(10) r(k))"""


JOINED = f"""
nm AS (SELECT map_from_entries(list((CAST(c_custkey AS VARCHAR), c_name))) AS nm FROM customer),
stripped AS (SELECT *, {emoji(urls('content'))} AS stripped FROM messages, nm),
named AS (
  SELECT * EXCLUDE (content, stripped, nm),
         CASE WHEN starts_with(content, '/kc') OR userid = {CFG.bot_id} THEN ''
              ELSE {spaces(mentions('stripped').replace(name_of('id'), 'nm[id]'))} END AS content
  FROM stripped)"""


def from_messages(select: str) -> str:
    return f"WITH {MESSAGES} SELECT {select} FROM messages"


def prompt(response: str | None) -> str:
    parts = [quoted(INSTRUCTION_HEADER), "instruction", quoted(INPUT_HEADER), "input", quoted(RESPONSE_HEADER)]
    return "concat(" + ", ".join(parts + ([response] if response else [])) + ")"


ORACLES: dict[str, str] = {
    # Sources and sinks
    "scan_messages": from_messages("*"),
    "incremental_ingest": f"WITH {INGEST} SELECT * FROM fetched",
    "append_roundtrip": from_messages("*"),
    "rewrite_roundtrip": f"""WITH RECURSIVE {MESSAGES}, {with_assigned()}, {cleaned(True, 'joined')}
        SELECT messageid, channelid, channelname, userid, username, sent, content, replyid, conversid, isFirstInConvers FROM clean""",
    "names_dim": """SELECT event_id, id, json_extract_string(props, '$.' || id) AS name
        FROM (SELECT event_id, props, unnest(json_keys(props)) AS id FROM events)""",
    "examples_roundtrip": f"WITH RECURSIVE {EXAMPLES} SELECT * FROM examples",
    "json_roundtrip": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CAST(to_json({'k': CAST(json_extract_string(props, '$.k') AS BIGINT)}) AS VARCHAR) AS json FROM events""",
    "parse_sent": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts
        ELSE date_trunc('second', ts) - INTERVAL '5 hours 30 minutes' END AS sent FROM events""",
    "format_sent": """SELECT event_id,
        CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%d %H:%M:%S+00:00')
             ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f+00:00') END AS sent_text,
        strftime(ts, '%Y-%m-%d %H:%M:%S+00:00') AS whole_text FROM events""",
    # Filters, order, limits
    "message_table": from_messages("messageid, channelid, userid, sent, content"),
    "channel_list": """SELECT c_custkey, CAST(k - 1 AS INTEGER) AS ordinal, TRY_CAST(ids[k] AS BIGINT) AS channelid
        FROM (SELECT c_custkey, [CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR),
                                 c_mktsegment] AS ids FROM customer), range(1, 5) r(k)""",
    "parse_sent_bad": """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN date_trunc('second', ts) + INTERVAL 3 HOUR END AS sent
        FROM events""",
    "format_sent_zoned": """SELECT event_id, concat(strftime(u, '%Y-%m-%d %H:%M:%S'),
               CASE WHEN date_trunc('second', u) = u THEN '' ELSE strftime(u, '.%f') END, '+00:00') AS sent_text
        FROM (SELECT event_id, ts + INTERVAL 5 HOUR AS u FROM events)""",
    "channel_filter": from_messages("messageid, channelid, userid, sent, content") + " WHERE channelid = 7",
    "channel_semi_join": f"""WITH {MESSAGES}, {CHANNELS}
        SELECT messageid, channelid, userid, sent FROM messages WHERE channelid IN (SELECT channelid FROM channels)""",
    "ordered_messages": from_messages("messageid, channelid, sent") + " ORDER BY sent, messageid",
    "latest_n_per_channel": f"""WITH {MESSAGES}
        SELECT channelid, string_agg(CAST(messageid AS VARCHAR), ',' ORDER BY sent, messageid) AS items
        FROM (SELECT * FROM messages
              QUALIFY row_number() OVER (PARTITION BY channelid ORDER BY sent DESC, messageid DESC) <= 10)
        GROUP BY channelid""",
    "first_candidate": "SELECT doc_id, string_split(text, ' ')[1] AS candidate FROM documents",
    # Joins and checks
    "reply_join": f"""WITH {MESSAGES}
        SELECT m.messageid, m.channelid, m.replyid, t.channelid AS target_channelid,
               t.userid AS target_userid, t.sent AS target_sent
        FROM messages m LEFT JOIN messages t ON t.messageid = m.replyid WHERE m.replyid IS NOT NULL""",
    "unresolved_refs": f"""WITH {MESSAGES}, {CHANNELS},
        names AS (SELECT CAST(channelid AS VARCHAR) AS id FROM channels WHERE channelid NOT IN (1, 2, 3, 4)
                  UNION ALL SELECT unnest(['1', '2']))
        SELECT 'author' AS kind, count(*) AS messages FROM messages
          WHERE userid <> 4 AND CAST(userid AS VARCHAR) NOT IN (SELECT id FROM names)
        UNION ALL SELECT 'channel', count(*) FROM messages
          WHERE CAST(channelid AS VARCHAR) NOT IN (SELECT id FROM names)
        UNION ALL SELECT 'reply_target', count(*) FROM messages m WHERE replyid IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM messages t WHERE t.messageid = m.replyid AND t.channelid = m.channelid
             AND (t.sent < m.sent OR (t.sent = m.sent AND t.messageid < m.messageid)))
        UNION ALL SELECT 'sent', count(*) FROM messages WHERE sent IS NULL""",
    # Aggregates
    "latest_per_channel": f"""WITH {MESSAGES} SELECT channelid, messageid FROM messages
        QUALIFY row_number() OVER (PARTITION BY channelid ORDER BY sent DESC, messageid DESC) = 1""",
    "max_conversation": f"WITH RECURSIVE {MESSAGES}, {assigned('messages')} SELECT max(conversid) AS max_conversid FROM assigned",
    "distinct_conversations": f"WITH RECURSIVE {MESSAGES}, {assigned('messages')} SELECT DISTINCT conversid FROM assigned",
    "ingest_stats": f"""WITH {INGEST.replace('QUALIFY row_number() OVER (PARTITION BY m.channelid ORDER BY m.sent, m.messageid) <= 5', '')}
        SELECT channelid, count(*) AS fetched FROM fetched GROUP BY channelid""",
    "clean_stats": f"""WITH {MESSAGES}, {cleaned(True)}
        SELECT count(*) FILTER (WHERE k.content <> '' AND k.content <> m.content) AS cleaned,
               count(*) FILTER (WHERE k.content = '') AS empty
        FROM clean k JOIN messages m USING (messageid)""",
    "conversation_stats": f"""WITH RECURSIVE {MESSAGES}, {assigned('messages')}
        SELECT channelid, count(*) AS sorted, count(*) FILTER (WHERE isFirstInConvers) AS conversations
        FROM assigned GROUP BY channelid""",
    "example_stats": f"""WITH RECURSIVE {EXAMPLES}
        SELECT (SELECT count(*) FROM examples) AS examples,
               (SELECT count(DISTINCT conversid) FROM assigned) AS conversations""",
    # Text
    "strip_urls": from_messages(f"messageid, {urls('content')} AS text"),
    "strip_urls_pages": f"SELECT page_id, {urls('html')} AS text FROM pages",
    "strip_emoji": from_messages(f"messageid, {emoji('content')} AS text"),
    "mention_ids": from_messages(f"messageid, array_to_string({ids('content')}, ',') AS ids"),
    "replace_mentions": from_messages(f"messageid, {mentions('content')} AS text"),
    "collapse_ws": from_messages(f"messageid, {spaces('content')} AS text"),
    "collapse_ws_documents": f"SELECT doc_id, {spaces('text')} AS text FROM documents",
    "clean_training": f"WITH {MESSAGES}, {cleaned(True)} SELECT messageid, content FROM clean",
    "clean_inference": f"WITH {MESSAGES}, {cleaned(False)} SELECT messageid, content FROM clean",
    "clean_documents": f"""WITH docs AS (SELECT doc_id, doc_id AS userid, text AS content FROM documents),
        {cleaned(True, 'docs')} SELECT doc_id, content FROM clean""",
    "format_messages": f"""WITH {MESSAGES}, {cleaned(False)}
        SELECT messageid, {live_line()} AS line FROM clean WHERE content <> ''""",
    # Conversations
    "prev_message": f"""WITH {MESSAGES}
        SELECT messageid, channelid, lag(messageid) OVER w AS prev_messageid, lag(userid) OVER w AS prev_userid,
               lag(sent) OVER w AS prev_sent
        FROM messages WINDOW w AS (PARTITION BY channelid ORDER BY sent, messageid)""",
    "author_runs": f"""WITH {MESSAGES},
        p AS (SELECT *, lag(userid) OVER w AS pu, lag(sent) OVER w AS ps FROM messages
              WINDOW w AS (PARTITION BY channelid ORDER BY sent, messageid)),
        r AS (SELECT *, CAST(sum(CASE WHEN pu IS NULL OR pu <> userid THEN 1 ELSE 0 END)
                OVER (PARTITION BY channelid ORDER BY sent, messageid) AS BIGINT) AS run FROM p)
        SELECT messageid, channelid, run,
               first_value(ps) OVER (PARTITION BY channelid, run ORDER BY sent, messageid) AS anchor_sent FROM r""",
    "conversation_breaks": f"""WITH RECURSIVE {MESSAGES}, {assigned('messages')}
        SELECT messageid, channelid, is_break FROM walk""",
    "conversation_heads": f"""WITH RECURSIVE {MESSAGES}, {assigned('messages')}
        SELECT messageid, channelid, head FROM walk""",
    "assign_conversations": f"""WITH RECURSIVE {MESSAGES}, {assigned('messages')}
        SELECT messageid, conversid, isFirstInConvers FROM assigned""",
    "assign_conversations_listed": f"""WITH RECURSIVE {MESSAGES}, {CHANNELS},
        listed AS (SELECT * FROM messages WHERE channelid IN (SELECT channelid FROM channels)),
        {assigned('listed').replace('ORDER BY channelid, sent, messageid', 'ORDER BY -channelid, sent, messageid')}
        SELECT messageid, conversid, isFirstInConvers FROM assigned""",
    "assign_conversations_incremental":
        f"WITH RECURSIVE {HALVES} SELECT messageid, conversid, isFirstInConvers FROM assigned",
    "conversation_position": f"""WITH RECURSIVE {MESSAGES}, {with_assigned()}
        SELECT messageid, conversid,
               row_number() OVER (PARTITION BY conversid ORDER BY sent, messageid) - 1 AS position FROM joined""",
    # Examples, prompts, splits
    "training_examples": f"WITH RECURSIVE {EXAMPLES} SELECT * FROM examples",
    "role_examples": f"""WITH src AS (
          SELECT conv_id * 1000000 + turn AS messageid, conv_id AS conversid, role, turn AS sent, text AS content,
                 CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 WHEN 'user' THEN 3 END AS userid,
                 turn = 0 AS isFirstInConvers FROM conversations),
        {example_rows('src', 'role', ROLE_CFG.instruction_text, ROLE_CFG.user_id)} SELECT * FROM examples""",
    "chat_triggers": f"WITH {MESSAGES} {TRIGGERS}",
    "chat_context": CONTEXT_ROWS,
    "render_training_prompt": f"WITH RECURSIVE {EXAMPLES} SELECT messageid, {prompt('output')} AS prompt FROM examples",
    "completion_span": f"""WITH RECURSIVE {EXAMPLES}
        SELECT messageid, CAST(length({prompt(None)}) AS INTEGER) AS completion_start, output AS completion FROM examples""",
    "render_inference_prompt": f"""WITH {CONTEXT},
        asked AS (SELECT messageid, {quoted(CFG.instruction_text)} AS instruction, context AS input FROM contexts WHERE trigger)
        SELECT messageid, {prompt(None)} AS prompt FROM asked""",
    "kfold_split": f"{FOLDED} SELECT fold, split, messageid FROM folds",
    "kfold_sizes": f"{FOLDED} SELECT fold, split, count(*) AS rows FROM folds GROUP BY fold, split",
    "random_split": f"""WITH RECURSIVE {EXAMPLES}
        SELECT messageid, CASE WHEN row_number() OVER (ORDER BY (messageid * 7919 + 17) % 1000003, messageid)
                 <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM examples""",
    # The plans for large groups and joined names
    "assign_conversations_split": f"""WITH RECURSIVE {MESSAGES}, {assigned('messages')}
        SELECT messageid, conversid, isFirstInConvers FROM assigned""",
    "training_examples_split": f"WITH RECURSIVE {EXAMPLES} SELECT * FROM examples",
    "trigger_gate_split": GATE,
    "clean_training_joined": f"WITH {MESSAGES}, {JOINED} SELECT messageid, content FROM named",
    "format_messages_joined": f"""WITH {MESSAGES}, {JOINED}
        SELECT messageid, concat(CASE WHEN userid = {CFG.bot_id} THEN {quoted(CFG.bot_label)} ELSE c_name END, ': ', content) AS line
        FROM named LEFT JOIN customer ON c_custkey = userid WHERE content <> ''""",
    # Streams
    "stream_ingest_backfill": from_messages("messageid, channelid, userid, sent, content, replyid"),
    "stream_context_unordered": CONTEXT_ROWS,
    "stream_ingest": from_messages("messageid, channelid, userid, sent, content, replyid"),
    "stream_triggers": f"WITH {MESSAGES} {TRIGGERS}",
    "stream_context": CONTEXT_ROWS,
    "stream_gate": GATE,
    "live_context": CONTEXT_ROWS,
    "live_gate": GATE,
    "sql_surface": f"""WITH RECURSIVE {EXAMPLES}, {CONTEXT.removeprefix(MESSAGES + ",").replace("clean", "alive").replace("stripped", "bare")}
        SELECT m.messageid, k.content AS text, a.content AS live,
               CASE WHEN k.content <> '' THEN concat(CASE WHEN m.userid = {CFG.bot_id} THEN {quoted(CFG.bot_label)}
                 ELSE {name_of('CAST(m.userid AS VARCHAR)')} END, ': ', k.content) END AS line,
               l.line AS live_line,
               CASE WHEN e.messageid IS NOT NULL THEN {prompt('e.output').replace('instruction', 'e.instruction').replace(', input', ', e.input')} END AS example,
               CASE WHEN x.messageid IS NOT NULL THEN {prompt(None).replace('instruction', quoted(CFG.instruction_text)).replace(', input', ', x.context')} END AS asked,
               x.context
        FROM messages m JOIN clean k USING (messageid) JOIN alive a USING (messageid) JOIN lines l USING (messageid)
        LEFT JOIN examples e ON e.messageid = m.messageid LEFT JOIN (SELECT * FROM contexts WHERE trigger) x ON x.messageid = m.messageid""",
    "stream_ingest_json": f"""WITH {MESSAGES}
        SELECT messageid, channelid, userid, sent, content, replyid, NULL AS line FROM messages
        WHERE messageid % 97 <> 0 AND messageid % 89 <> 0
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL,
          CASE WHEN messageid % 97 = 0 THEN concat('{{"id": ', messageid, ', "channel') ELSE concat('{{"content":"', messageid, '"}}') END
        FROM messages WHERE messageid % 97 = 0 OR messageid % 89 = 0""",
    "stream_assign": f"""WITH RECURSIVE {MESSAGES},
        part_1 AS (SELECT * FROM messages WHERE sent < {SPLIT_AT} AND messageid % 11 <> 0 AND channelid % 5 <> 0),
        part_2 AS (SELECT * FROM messages WHERE sent < {SPLIT_AT} AND (messageid % 11 = 0 OR channelid % 5 = 0)),
        part_3 AS (SELECT * FROM messages WHERE sent >= {SPLIT_AT}),
        {assign_over('_1', None, 'part_1')}, {assign_over('_2', 'stored_1', 'part_2')}, {assign_over('_3', 'stored_2', 'part_3')}
        SELECT messageid, conversid, isFirstInConvers FROM stored_3""",
    "trigger_gate": GATE,
}
