"""DuckDB statements that restate each registered query from its definition.

These are the plain (single-level) forms of the rules: whole-thread windows,
``string_agg`` with ORDER BY, ``arg_max`` and so on.  They read the same
parquet tables (registered as views by the checker).
"""

from __future__ import annotations

TS_FMT = "'%Y-%m-%d %H:%M:%S'"
GAP6_US = 6 * 3600 * 1_000_000

M_EVENTS = """m AS (
  SELECT 'events' AS owner_id, CAST(user_id AS VARCHAR) AS thread_id, event_id AS seq,
         date_trunc('second', ts) AS ts,
         CASE WHEN event_type = 'click' THEN 'Me' ELSE event_type END AS speaker,
         event_type || ' ' || printf('%.2f', value) AS content,
         value > 100.0 AS is_reply,
         CASE WHEN value > 100.0 THEN 'event ' || CAST(event_id AS VARCHAR) END AS reply_info
  FROM events)"""

M_CONV = """m AS (
  SELECT 'convs' AS owner_id, CAST(conv_id AS VARCHAR) AS thread_id, turn AS seq,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS ts,
         CASE WHEN role = 'assistant' THEN 'Me' ELSE role END AS speaker,
         text AS content, false AS is_reply, CAST(NULL AS VARCHAR) AS reply_info
  FROM conversations)"""


def scan_ctes(m_cte: str, gap_us: int = GAP6_US) -> str:
    """``m`` -> ``e``: messages with conv_no and turn_idx (plain windows)."""
    return f"""{m_cte},
a AS (SELECT *, lag(ts) OVER w AS pts, lag(speaker) OVER w AS pspk, row_number() OVER w AS rn
      FROM m WINDOW w AS (PARTITION BY owner_id, thread_id ORDER BY seq)),
b AS (SELECT *, CASE WHEN rn = 1 OR epoch_us(ts) - epoch_us(pts) > {gap_us} THEN 1 ELSE 0 END AS cf FROM a),
c AS (SELECT *, CASE WHEN cf = 1 OR speaker IS DISTINCT FROM pspk THEN 1 ELSE 0 END AS isf FROM b),
d AS (SELECT *, sum(cf) OVER w2 - 1 AS conv_no0, sum(isf) OVER w2 AS isl
      FROM c WINDOW w2 AS (PARTITION BY owner_id, thread_id ORDER BY seq
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, CAST(conv_no0 AS INTEGER) AS conv_no,
             CAST(isl - min(isl) OVER (PARTITION BY owner_id, thread_id, conv_no0) AS INTEGER) AS turn_idx
      FROM d)"""


def turns_ctes(m_cte: str, first: bool = False) -> str:
    """``m`` -> ``t``: merged turns (timestamp typed)."""
    if first:
        agg = """arg_min_null(ts, seq) AS ts, arg_min_null(is_reply, seq) AS is_reply,
                 arg_min_null(reply_info, seq) AS reply_info"""
    else:
        agg = """arg_max(ts, seq) AS ts, bool_or(is_reply) AS is_reply,
                 arg_max(reply_info, CASE WHEN is_reply THEN seq END) AS reply_info"""
    return f"""{scan_ctes(m_cte)},
t AS (SELECT owner_id, thread_id, conv_no, turn_idx, {agg}, any_value(speaker) AS speaker,
             string_agg(content, '<|msg|>' ORDER BY seq) AS content,
             CAST(count(*) AS INTEGER) AS n_msgs
      FROM e GROUP BY owner_id, thread_id, conv_no, turn_idx)"""


def store_ctes(m_cte: str, num: int, lo: int, hi: int, banned=("sex", "sexy", "gamepigeon")) -> str:
    ban = " OR ".join(f"contains(lower(content), '{b}')" for b in banned)
    return f"""{turns_ctes(m_cte)},
cs AS (SELECT owner_id, thread_id, conv_no, CAST(count(*) AS INTEGER) AS n_turns,
              arg_max(ts, turn_idx) AS last_ts, bool_or({ban}) AS has_banned
       FROM t GROUP BY owner_id, thread_id, conv_no),
st AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id
                      ORDER BY last_ts DESC NULLS LAST, thread_id, conv_no) AS INTEGER) AS store_rank
       FROM cs WHERE NOT has_banned AND n_turns BETWEEN {lo} AND {hi}),
store AS (SELECT * FROM st WHERE store_rank <= {num})"""


ORACLE: dict[str, str] = {}

ORACLE["sessionize_events"] = f"""WITH {scan_ctes(M_EVENTS)}
SELECT owner_id, thread_id, seq, strftime(ts, {TS_FMT}) AS ts, speaker, conv_no FROM e"""

ORACLE["merge_turns"] = f"""WITH {turns_ctes(M_EVENTS)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, speaker, content,
       is_reply, reply_info, n_msgs FROM t"""

ORACLE["merge_turns_first"] = f"""WITH {turns_ctes(M_EVENTS, first=True)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, speaker, content,
       is_reply, reply_info, n_msgs FROM t"""

ORACLE["conversation_store_recent"] = f"""WITH {store_ctes(M_EVENTS, 1000, 2, 75)}
SELECT owner_id, thread_id, conv_no, n_turns, strftime(last_ts, {TS_FMT}) AS last_ts, store_rank FROM store"""


ORACLE["conversation_store_memory"] = f"""WITH {store_ctes(M_EVENTS, 8000, 5, 500)}
SELECT t.owner_id, t.thread_id, t.conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, speaker, content, is_reply, reply_info, n_msgs, store_rank
FROM t JOIN store USING (owner_id, thread_id, conv_no)"""

ORACLE["conversations_round_trip"] = f"""WITH {turns_ctes(M_CONV)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, speaker, content, is_reply, reply_info, n_msgs FROM t"""


# --------------------------------------------------------------------------
# Training examples: whole-prompt text rules
# --------------------------------------------------------------------------

from chatlake.functions import text as _tx  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NONWS = _tx.NON_WS_RUN
TSRE = _tx.TS_BRACKET_RE
STRIP = _tx.STRIP_RE
EMOJI = _tx.EMOJI_CLASS
NL = "chr(10)"


def _n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(NONWS)}))"


def _max_delims(x: str) -> str:
    return f"list_max(list_transform(string_split({x}, {NL}), lambda l: len(string_split(l, '<|msg|>')) - 1))"


def _max_piece_words(x: str) -> str:
    return (f"list_max(list_transform(regexp_split_to_array({x}, {_q(TSRE)}), lambda p: "
            f"list_max(list_transform(string_split(p, '<|msg|>'), lambda s: "
            f"{_n_words('substr(s, instr(s, chr(58)) + 1)')}))))")


def _contains_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_q(n.lower())})" for n in needles) + ")"


ALL_REASONS = ("filtered_strings", "too_short", "too_many_consecutive_msgs_input", "too_many_consecutive_msgs_output",
               "contains_url", "excessive_repetition", "too_many_speakers", "emoji_only", "too_many_messages",
               "long_messages_input", "long_messages_output", "too_little_messages_input")


def reason_sql(max_words: int = 50, min_ts: int = 3, banned=tuple(_tx.EXAMPLE_BANNED_STRINGS), enabled=ALL_REASONS,
               max_ts: int = 35, max_speakers: int = 1) -> str:
    stop = ", ".join(_q(w) for w in _tx.STOP_WORDS)
    rep = (f"(SELECT coalesce(max(cnt), 0) FROM (SELECT count(*) AS cnt FROM "
           f"unnest(regexp_extract_all(lower(output), {_q(NONWS)})) AS u(w) WHERE w NOT IN ({stop}) GROUP BY w))")
    spk = (f"len(list_distinct(list_filter(list_transform(list_filter(string_split(input, {NL}), "
           f"lambda l: contains(l, '] ') AND contains(l, ': ')), "
           f"lambda l: split_part(string_split(l, '] ')[2], ': ', 1)), lambda s: s <> 'Me')))")
    nts = f"len(regexp_extract_all(input, {_q(TSRE)}))"
    rules = {
        "filtered_strings": f"{_contains_any('input', banned)} OR {_contains_any('output', banned)}",
        "too_short": f"{_n_words('output')} <= 2",
        "too_many_consecutive_msgs_input": f"{_max_delims('input')} > 20",
        "too_many_consecutive_msgs_output": f"{_max_delims('output')} > 20",
        "contains_url": _contains_any('output', _tx.URL_PATTERNS),
        "excessive_repetition": f"{rep} > 15",
        "too_many_speakers": f"{spk} > {max_speakers}",
        "emoji_only": f"regexp_replace(regexp_replace(output, {_q(STRIP)}, '', 'g'), {_q(EMOJI)}, '', 'g') = ''",
        "too_many_messages": f"{nts} > {max_ts}",
        "long_messages_input": f"coalesce({_max_piece_words('input')}, 0) > {max_words}",
        "long_messages_output": f"coalesce({_max_piece_words('output')}, 0) > {max_words}",
        "too_little_messages_input": f"{nts} <= {min_ts}",
    }
    cases = "".join(f"\n  WHEN {rules[r]} THEN '{r}'" for r in ALL_REASONS if r in enabled)
    return f"CASE{cases}\nEND" if cases else "CAST(NULL AS VARCHAR)"


SYSTEM_PROMPT_SQL = _q("You are a human being named Me. You are not an AI. Respond as yourself. "
                       "Now you may begin the conversation.")


def examples_ctes(m_cte: str, buffer: int = 0, max_words: int = 50, min_ts: int = 3,
                  banned=tuple(_tx.EXAMPLE_BANNED_STRINGS), max_speakers: int = 1) -> str:
    """``m`` -> ``xr``: every target with its full prompt text and reason."""
    fmt = f"strftime(ts, {TS_FMT})"
    prior = "''"
    pc = ""
    join = ""
    if buffer > 0:
        pc = f""",
ct AS (SELECT owner_id, thread_id, conv_no, string_agg(line, {NL} ORDER BY turn_idx) AS ctext
       FROM tl GROUP BY owner_id, thread_id, conv_no),
pc AS (SELECT owner_id, thread_id, conv_no,
              list(ctext || {NL} || '---' || {NL}) OVER (PARTITION BY owner_id, thread_id ORDER BY conv_no
                   ROWS BETWEEN {buffer} PRECEDING AND 1 PRECEDING) AS pl FROM ct)"""
        join = "LEFT JOIN pc USING (owner_id, thread_id, conv_no)"
        prior = f"CASE WHEN pl IS NULL THEN '' ELSE 'Previous conversations:' || {NL} || array_to_string(pl, '') END"
    return f"""{turns_ctes(m_cte)},
tl AS (SELECT *, '[' || {fmt} || '] ' || speaker || ': ' || content AS line FROM t),
h AS (SELECT *, list(line) OVER (PARTITION BY owner_id, thread_id, conv_no ORDER BY turn_idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hl FROM tl){pc},
x AS (SELECT h.owner_id, h.thread_id, h.conv_no, h.turn_idx, h.ts,
             {SYSTEM_PROMPT_SQL} || {NL} AS instruction,
             {prior} || 'Current conversation:' || {NL}
               || coalesce(array_to_string(list_transform(hl, lambda l: l || {NL}), ''), '')
               || '[' || {fmt} || '] Me: ' AS input,
             content AS output
      FROM h {join}
      WHERE speaker = 'Me' AND NOT is_reply
        AND regexp_replace(content, {_q(STRIP)}, '', 'g') NOT IN ('', '<|msg|>')),
xr AS (SELECT *, {reason_sql(max_words, min_ts, banned, max_speakers=max_speakers)} AS reject_reason FROM x)"""


M_MIXED = """m0 AS (SELECT conv_id AS c, turn AS k, conv_id // 10 AS th, role, text FROM conversations),
m AS (
  SELECT 'mixed' AS owner_id, CAST(th AS VARCHAR) AS thread_id, c * 100 + k AS seq,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c * 3600 + k * 60) AS ts,
         CASE WHEN role = 'assistant' THEN 'Me' WHEN th % 6 = 2 AND c % 10 = 5 THEN 'guest' WHEN th % 6 = 2 AND c % 10 = 6 THEN 'third' ELSE role END AS speaker,
         CASE WHEN th % 6 = 0 AND c % 10 = 9 AND k = 2 THEN 'gamepigeon MESSAGE: ' || text
              WHEN th % 6 = 1 AND c % 10 = 8 AND k = 2 THEN repeat('a <|msg|> ', 21) || left(text, 40)
              WHEN th % 6 = 4 AND c % 10 = 5 THEN text
              WHEN th % 6 = 5 AND c % 10 = 9 AND role = 'assistant' THEN 'see ' || repeat('a <|msg|> ', 21) || 'b'
              WHEN role = 'assistant' AND c % 10 = 2 THEN 'ok fine'
              WHEN role = 'assistant' AND c % 10 = 1 THEN chr(128512) || chr(12288) || chr(128512) || chr(12288) || chr(128512)
              WHEN role = 'assistant' AND c % 10 = 3 THEN 'see WWW.x.com ' || left(text, 40)
              WHEN role = 'assistant' AND c % 10 = 4 THEN repeat('dog ', 16) || 'and cat'
              ELSE left(text, 40) END AS content,
         false AS is_reply, CAST(NULL AS VARCHAR) AS reply_info
  FROM m0)"""

REASON_ORDER = ["filtered_strings", "too_short", "too_many_consecutive_msgs_input",
                "too_many_consecutive_msgs_output", "contains_url", "excessive_repetition",
                "too_many_speakers", "emoji_only", "too_many_messages", "long_messages_input",
                "long_messages_output", "too_little_messages_input"]
_REASON_VALUES = ", ".join(f"({i}, {_q(r)})" for i, r in enumerate(REASON_ORDER))

ORACLE["filter_reasons"] = f"""WITH {examples_ctes(M_EVENTS)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, reject_reason FROM xr"""

ORACLE["filter_reasons_conv"] = f"""WITH {examples_ctes(M_CONV)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, reject_reason FROM xr"""

ORACLE["filter_stats"] = f"""WITH {examples_ctes(M_EVENTS)},
r(ord, reject_reason) AS (VALUES {_REASON_VALUES})
SELECT CAST(r.ord AS INTEGER) AS ord, r.reject_reason,
       CAST((SELECT count(*) FROM xr WHERE xr.reject_reason = r.reject_reason) AS BIGINT) AS removed
FROM r"""

ORACLE["filter_reasons_mixed"] = f"""WITH {examples_ctes(M_MIXED)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, reject_reason FROM xr"""

ORACLE["filter_stats_mixed"] = f"""WITH {examples_ctes(M_MIXED)},
r(ord, reject_reason) AS (VALUES {_REASON_VALUES})
SELECT CAST(r.ord AS INTEGER) AS ord, r.reject_reason,
       CAST((SELECT count(*) FROM xr WHERE xr.reject_reason = r.reject_reason) AS BIGINT) AS removed
FROM r"""

ORACLE["filter_two_speakers"] = f"""WITH {examples_ctes(M_MIXED, buffer=1, max_words=400, max_speakers=2)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, reject_reason FROM xr"""

ORACLE["history_examples"] = f"""WITH {examples_ctes(M_EVENTS)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, instruction, input, output
FROM xr WHERE reject_reason IS NULL"""

ORACLE["prior_context"] = f"""WITH {examples_ctes(M_EVENTS, buffer=2)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, instruction, input, output,
       reject_reason
FROM xr"""

ORACLE["history_examples_conv"] = f"""WITH {examples_ctes(M_CONV, max_words=200)}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, instruction, input, output
FROM xr WHERE reject_reason IS NULL"""


# --------------------------------------------------------------------------
# Subsets: the greedy loop as a recursive CTE
# --------------------------------------------------------------------------

R_EVENTS = f"""{M_EVENTS},
r AS (SELECT owner_id, thread_id, seq, ts, epoch_us(ts) AS t FROM m)"""

LADDER_SQL = [("B25", 25, 24), ("B50", 50, 12), ("B100", 100, 12), ("B250", 250, 4), ("B500", 500, 2),
              ("B1k", 1000, 1), ("B2k", 2000, None), ("B4k", 4000, None), ("B8k", 8000, None)]


def subset_ctes(src: str, name: str, size: int, gap_h) -> tuple[str, str]:
    """CTEs selecting ``(subset_name, owner_id, seq, picked)`` into ``{name}_sel``."""
    p = f"s_{name}"
    ok = f"{p}_ok AS (SELECT owner_id FROM {src} GROUP BY owner_id HAVING count(*) >= {size})"
    if gap_h is None:
        body = f"""{ok},
{p}_sel AS (SELECT '{name}' AS subset_name, owner_id, seq, false AS picked FROM (
    SELECT owner_id, seq, row_number() OVER (PARTITION BY owner_id ORDER BY t DESC, seq DESC) AS rn
    FROM {src} SEMI JOIN {p}_ok USING (owner_id)) WHERE rn <= {size})"""
        return body, f"{p}_sel"
    gap = int(gap_h * 3600 * 1_000_000)
    body = f"""{ok},
{p}_d AS (SELECT owner_id, t, min(seq) AS rseq FROM {src} GROUP BY owner_id, t),
{p}_ch(owner_id, t, pos) AS (
    SELECT owner_id, max(t), 0 FROM {src} SEMI JOIN {p}_ok USING (owner_id) GROUP BY owner_id
    UNION ALL
    SELECT c.owner_id,
           (SELECT max(d.t) FROM {p}_d d WHERE d.owner_id = c.owner_id AND d.t <= c.t - {gap} AND d.t > 0),
           c.pos + 1
    FROM {p}_ch c WHERE c.t IS NOT NULL AND c.pos + 1 < {size}),
{p}_pk AS (SELECT c.owner_id, d.rseq AS seq FROM {p}_ch c JOIN {p}_d d USING (owner_id, t)
           WHERE c.t IS NOT NULL),
{p}_np AS (SELECT owner_id, count(*) AS np FROM {p}_pk GROUP BY owner_id),
{p}_fill AS (SELECT owner_id, seq FROM (
    SELECT x.owner_id, x.seq, x.rn, coalesce(n.np, 0) AS np FROM (
        SELECT owner_id, seq, row_number() OVER (PARTITION BY owner_id ORDER BY t DESC, seq) AS rn
        FROM (SELECT * FROM {src} SEMI JOIN {p}_ok USING (owner_id)) a
        ANTI JOIN {p}_pk USING (owner_id, seq)) x
    LEFT JOIN {p}_np n USING (owner_id)) WHERE rn <= {size} - np),
{p}_sel AS (SELECT '{name}' AS subset_name, owner_id, seq, true AS picked FROM {p}_pk
            UNION ALL SELECT '{name}', owner_id, seq, false FROM {p}_fill)"""
    return body, f"{p}_sel"


def subset_rows(src: str, sel: str) -> str:
    return f"""SELECT s.subset_name, r.owner_id, r.thread_id, r.seq, strftime(r.ts, {TS_FMT}) AS ts, s.picked,
       CAST(row_number() OVER (PARTITION BY s.subset_name, r.owner_id ORDER BY r.t, r.seq) - 1 AS INTEGER) AS pos
FROM {sel} s JOIN {src} r USING (owner_id, seq)"""


def ladder_sql(specs=LADDER_SQL) -> tuple[str, list[str]]:
    bodies, sels = [], []
    for name, size, gap in specs:
        b, s = subset_ctes("r", name, size, gap)
        bodies.append(b)
        sels.append(s)
    union = " UNION ALL ".join(f"SELECT * FROM {s}" for s in sels)
    return ",\n".join(bodies) + f",\nladder AS ({union})", sels


_b250, _s250 = subset_ctes("r", "B250", 250, 4)
ORACLE["spaced_subset"] = f"""WITH RECURSIVE {R_EVENTS},
{_b250}
{subset_rows('r', _s250)}"""

_b2k, _s2k = subset_ctes("r", "B2k", 2000, None)
ORACLE["tail_subset"] = f"""WITH RECURSIVE {R_EVENTS},
{_b2k}
{subset_rows('r', _s2k)}"""

_lad, _ = ladder_sql()
ORACLE["subset_ladder"] = f"""WITH RECURSIVE {R_EVENTS},
{_lad}
{subset_rows('r', 'ladder')}"""

_vb, _vs = subset_ctes("vc", "validation", 200, 1)
ORACLE["validation_split"] = f"""WITH RECURSIVE {R_EVENTS},
{_lad},
used AS (SELECT DISTINCT r.owner_id, r.ts FROM ladder l JOIN r USING (owner_id, seq)),
vc AS (SELECT * FROM r ANTI JOIN used USING (owner_id, ts)),
{_vb},
vsmall AS (SELECT 'validation' AS subset_name, owner_id, seq, false AS picked FROM vc
           WHERE owner_id NOT IN (SELECT owner_id FROM s_validation_ok)),
vall AS (SELECT * FROM {_vs} UNION ALL SELECT * FROM vsmall)
{subset_rows('vc', 'vall')}"""

ORACLE["duplicate_rows"] = f"""WITH RECURSIVE {R_EVENTS},
{_lad},
f(subset_name, factor) AS (VALUES ('B25', 4), ('B50', 2), ('B100', 2), ('B250', 1), ('B500', 1),
                                  ('B1k', 1), ('B2k', 1), ('B4k', 1), ('B8k', 1))
SELECT l.subset_name, l.owner_id, l.seq, CAST(g.copy AS INTEGER) AS copy
FROM ladder l JOIN f USING (subset_name), generate_series(1, f.factor) AS g(copy)"""

_DATASET_SPECS = [("S5", 5, 24), ("S20", 20, 4), ("T40", 40, None), ("T100k", 100000, None)]
_dlad, _ = ladder_sql(_DATASET_SPECS)
_dvb, _dvs = subset_ctes("vc", "validation", 15, 1)
_DATASET = f"""{examples_ctes(M_CONV, max_words=200, min_ts=1)},
r AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (ORDER BY thread_id, conv_no, turn_idx) AS seq FROM xr WHERE reject_reason IS NULL),
{_dlad},
used AS (SELECT DISTINCT r.owner_id, r.ts FROM ladder l JOIN r USING (owner_id, seq)),
vc AS (SELECT * FROM r ANTI JOIN used USING (owner_id, ts)),
{_dvb},
vsmall AS (SELECT 'validation' AS subset_name, owner_id, seq, false AS picked FROM vc
           WHERE owner_id NOT IN (SELECT owner_id FROM s_validation_ok)),
sets AS (SELECT subset_name, owner_id, seq FROM ladder UNION ALL SELECT subset_name, owner_id, seq FROM {_dvs}
         UNION ALL SELECT subset_name, owner_id, seq FROM vsmall UNION ALL SELECT 'full', owner_id, seq FROM r),
dset AS (SELECT s.subset_name, r.*, CAST(row_number() OVER (PARTITION BY s.subset_name, r.owner_id ORDER BY r.t, r.seq) - 1 AS INTEGER) AS pos
         FROM sets s JOIN r USING (owner_id, seq))"""

ORACLE["dataset_export"] = f"""WITH RECURSIVE {_DATASET}
SELECT owner_id, subset_name, pos, thread_id, conv_no, turn_idx, instruction, input, output, strftime(ts, {TS_FMT}) AS timestamp FROM dset"""

ORACLE["dataset_prompts"] = f"""WITH RECURSIVE {_DATASET},
f(subset_name, factor) AS (VALUES ('full', 1), ('S5', 4), ('S20', 2), ('T40', 1), ('validation', 1))
SELECT owner_id, subset_name, pos, CAST(copy AS INTEGER) AS copy, input AS prompt, output AS completion
FROM dset JOIN f USING (subset_name), generate_series(1, f.factor) AS g(copy)"""


def _level(name: str, enabled: tuple, max_ts: int, min_ts: int) -> str:
    sql = reason_sql(50, min_ts, ("GamePigeon message:",), enabled, max_ts)
    return f"SELECT '{name}' AS level, {sql} AS reject_reason FROM x"


_L45 = ("filtered_strings", "contains_url", "excessive_repetition")
_L25 = _L45 + ("too_many_speakers", "emoji_only", "too_many_messages", "long_messages_input", "long_messages_output", "too_little_messages_input")
ORACLE["dataset_levels"] = f"""WITH {examples_ctes(M_CONV)},
lv AS ({_level('60k', (), 35, 3)} UNION ALL {_level('45k', _L45, 35, 3)} UNION ALL {_level('25k', _L25, 30, 1)} UNION ALL {_level('15k', _L25, 30, 7)})
SELECT level, reject_reason, count(*) AS n FROM lv GROUP BY ALL"""

ORACLE["prompt_completion"] = f"""WITH {examples_ctes(M_CONV, max_words=200)}
SELECT input AS prompt, output AS completion FROM xr WHERE reject_reason IS NULL"""


# --------------------------------------------------------------------------
# Token statistics
# --------------------------------------------------------------------------

from chatlake.operators.stats import TOKEN_RE  # noqa: E402


def _tok(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), {_q(TOKEN_RE)})) AS BIGINT)"


STAT_CTES = f"""{examples_ctes(M_CONV, max_words=200)},
ds AS (SELECT 'conv_all' AS dataset, input, output FROM xr
       UNION ALL SELECT 'conv_kept', input, output FROM xr WHERE reject_reason IS NULL
       UNION ALL SELECT 'docs_' || lang, text, source FROM documents),
tc AS (SELECT dataset, {_tok('input')} AS input_tokens, {_tok('output')} AS output_tokens FROM ds),
tc2 AS (SELECT *, input_tokens + output_tokens AS combined_tokens FROM tc),
lf AS (SELECT dataset, 'input_tokens' AS measure, input_tokens AS n FROM tc2
       UNION ALL SELECT dataset, 'output_tokens', output_tokens FROM tc2
       UNION ALL SELECT dataset, 'combined_tokens', combined_tokens FROM tc2)"""

ORACLE["token_stats"] = f"""WITH {STAT_CTES}
SELECT dataset, measure, count(*) AS num_examples, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean,
       round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, max(n) AS max, min(n) AS min,
       round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95, round(stddev_pop(n), 6) AS std_dev
FROM lf GROUP BY dataset, measure"""

ORACLE["token_histogram"] = f"""WITH {STAT_CTES},
rg AS (SELECT dataset, measure,
              CASE WHEN min(n) = max(n) THEN min(n) - 0.5 ELSE min(n)::DOUBLE END AS lo_e,
              CASE WHEN min(n) = max(n) THEN max(n) + 0.5 ELSE max(n)::DOUBLE END AS hi_e
       FROM lf GROUP BY dataset, measure),
bn AS (SELECT lf.dataset, lf.measure,
              CAST(least(greatest(floor((n - lo_e) * 50 / (hi_e - lo_e)), 0), 49) AS INTEGER) AS bin
       FROM lf JOIN rg USING (dataset, measure)),
cnt AS (SELECT dataset, measure, bin, count(*) AS c FROM bn GROUP BY ALL),
allb AS (SELECT dataset, measure, lo_e, hi_e, CAST(b AS INTEGER) AS bin FROM rg, range(0, 50) AS r(b))
SELECT a.dataset, a.measure, a.bin, round(lo_e + a.bin * (hi_e - lo_e) / 50, 6) AS bin_lo,
       round(lo_e + (a.bin + 1) * (hi_e - lo_e) / 50, 6) AS bin_hi, CAST(coalesce(c, 0) AS BIGINT) AS n_examples
FROM allb a LEFT JOIN cnt USING (dataset, measure, bin)"""

ORACLE["token_summary"] = f"""WITH {STAT_CTES}
SELECT dataset, count(*) AS num_examples, CAST(sum(combined_tokens) AS BIGINT) AS total_tokens,
       round(avg(input_tokens), 6) AS avg_input, round(avg(output_tokens), 6) AS avg_output
FROM tc2 GROUP BY dataset
UNION ALL
SELECT 'TOTAL', count(*), CAST(sum(combined_tokens) AS BIGINT), NULL, NULL FROM tc2"""

_CT = f"""{turns_ctes(M_CONV)},
ctk AS (SELECT owner_id, thread_id, conv_no,
              CAST(sum({_tok("strftime(ts, " + TS_FMT + ") || ' ' || speaker || ': ' || content")}) AS BIGINT) AS n_tokens
        FROM t GROUP BY owner_id, thread_id, conv_no)"""

ORACLE["corpus_tokens"] = f"""WITH {_CT}
SELECT owner_id, count(*) AS n_conversations, CAST(sum(n_tokens) AS BIGINT) AS total_tokens, max(n_tokens) AS longest,
       count(*) FILTER (WHERE n_tokens > 1000) AS n_over_limit FROM ctk GROUP BY ROLLUP (owner_id)"""

ORACLE["over_limit_conversations"] = f"""WITH {_CT} SELECT * FROM ctk WHERE n_tokens > 1000"""

ORACLE["over_limit"] = f"""WITH {turns_ctes(M_CONV)}
SELECT owner_id, thread_id, conv_no,
       CAST(sum({_tok("strftime(ts, " + TS_FMT + ") || ' ' || speaker || ': ' || content")}) AS BIGINT) AS n_tokens,
       sum({_tok("strftime(ts, " + TS_FMT + ") || ' ' || speaker || ': ' || content")}) > 100000 AS over_limit
FROM t GROUP BY owner_id, thread_id, conv_no"""


# --------------------------------------------------------------------------
# Retrieval
# --------------------------------------------------------------------------

MEMS = """mm AS (
  SELECT 'events' AS owner_id, e.vec_id AS mem_id, e.embedding::DOUBLE[] AS emb, e.label,
         CASE WHEN e.label = 0 THEN 3 WHEN e.label <= 3 THEN 2 ELSE 1 END AS level,
         concat_ws(' ', coalesce(ev.event_type, 'memory'), printf('%.2f', coalesce(ev.value, 0.0)),
                   'label' || CAST(e.label AS VARCHAR)) AS attribute,
         CASE WHEN e.label = 9 THEN 'Summer 2023'
              ELSE strftime(date_trunc('second', ev.ts), '%Y-%m-%d %H:%M:%S') END AS ts_text
  FROM embeddings e LEFT JOIN events ev ON ev.event_id = e.vec_id),
rec AS (
  SELECT *, epoch_us(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S')) AS tu FROM mm),
rng AS (SELECT owner_id, min(tu) AS lo, max(tu) AS hi FROM rec GROUP BY owner_id),
mr AS (SELECT rec.*, coalesce((tu - lo)::DOUBLE / CASE WHEN hi = lo THEN 1000000 ELSE hi - lo END, 0.0) AS recency
       FROM rec JOIN rng USING (owner_id))"""

ORACLE["cosine_topk"] = f"""WITH {MEMS},
s AS (SELECT q.owner_id, q.mem_id AS query_id, m.mem_id, list_cosine_similarity(q.emb, m.emb) AS similarity
      FROM mm q JOIN mm m USING (owner_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id, query_id ORDER BY similarity DESC, mem_id) AS INTEGER) AS rank FROM s)
SELECT owner_id, query_id, rank, mem_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 6"""

ORACLE["recency_topk"] = f"""WITH {MEMS},
s AS (SELECT q.owner_id, q.mem_id AS query_id, m.mem_id,
             (1 - 0.15) * list_cosine_similarity(q.emb, m.emb) + 0.15 * m.recency AS score
      FROM mm q JOIN mr m USING (owner_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id, query_id ORDER BY score DESC, mem_id) AS INTEGER) AS rank FROM s)
SELECT owner_id, query_id, rank, mem_id, round(score, 6) AS score FROM r WHERE rank <= 6"""

ORACLE["flat_search_text"] = f"""WITH {MEMS},
s AS (SELECT q.owner_id, q.mem_id AS query_id, m.mem_id, m.ts_text, m.attribute,
             (1 - 0.15) * list_cosine_similarity(q.emb, m.emb) + 0.15 * m.recency AS score
      FROM mm q JOIN mr m USING (owner_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id, query_id ORDER BY score DESC, mem_id) AS rank FROM s)
SELECT owner_id, query_id,
       string_agg('[' || coalesce(ts_text, '') || '] ' || attribute || chr(10), '' ORDER BY rank) AS memory_text
FROM r WHERE rank <= 6 GROUP BY owner_id, query_id"""

ORACLE["keyword_topk"] = f"""WITH {MEMS},
qw AS (SELECT DISTINCT item_id AS query_id, w FROM benchmark,
       unnest(regexp_extract_all(lower(text), {_q(NONWS)})) AS u(w)),
p AS (SELECT 'events' AS owner_id, qw.query_id, mm.mem_id, count(*) AS matches
      FROM qw JOIN mm ON contains(lower(mm.attribute), qw.w) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id, query_id ORDER BY matches DESC, mem_id) AS INTEGER) AS rank FROM p)
SELECT owner_id, query_id, rank, mem_id, matches FROM r WHERE rank <= 6"""


def _knn(src_q: str, src_m: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (
    SELECT q.owner_id, q.mem_id AS parent_id, m.mem_id AS child_id,
           row_number() OVER (PARTITION BY q.owner_id, q.mem_id
                              ORDER BY list_cosine_similarity(q.emb, m.emb) DESC, m.mem_id) AS child_rank
    FROM {src_q} q JOIN {src_m} m USING (owner_id)) WHERE child_rank <= {k})"""


ORACLE["hierarchical_search"] = f"""WITH {MEMS},
l3 AS (SELECT * FROM mm WHERE level = 3), l2 AS (SELECT * FROM mm WHERE level = 2),
l1 AS (SELECT * FROM mm WHERE level = 1),
{_knn('mm', 'l3', 3, 't3')},
{_knn('l3', 'l2', 3, 'k32')},
{_knn('l2', 'l1', 2, 'k21')},
lv3 AS (SELECT owner_id, parent_id AS query_id, 3 AS level, child_rank AS r3, 0 AS r2, 0 AS r1,
               child_id AS mem_id FROM t3),
lv2 AS (SELECT a.owner_id, a.query_id, 2 AS level, a.r3, b.child_rank AS r2, 0 AS r1, b.child_id AS mem_id
        FROM lv3 a JOIN k32 b ON a.owner_id = b.owner_id AND a.mem_id = b.parent_id WHERE a.r3 <= 2),
lv1 AS (SELECT a.owner_id, a.query_id, 1 AS level, a.r3, a.r2, b.child_rank AS r1, b.child_id AS mem_id
        FROM lv2 a JOIN k21 b ON a.owner_id = b.owner_id AND a.mem_id = b.parent_id)
SELECT owner_id, query_id, CAST(level AS INTEGER) AS level, CAST(r3 AS INTEGER) AS r3, CAST(r2 AS INTEGER) AS r2,
       CAST(r1 AS INTEGER) AS r1, mem_id
FROM (SELECT * FROM lv3 UNION ALL SELECT * FROM lv2 UNION ALL SELECT * FROM lv1)"""

def _drill(chosen: str) -> str:
    """The three levels, with the rows of ``t3`` that ``chosen`` keeps expanded."""
    return f"""l3 AS (SELECT * FROM mm WHERE level = 3), l2 AS (SELECT * FROM mm WHERE level = 2),
l1 AS (SELECT * FROM mm WHERE level = 1),
{_knn('mm', 'l3', 3, 't3')},
{_knn('l3', 'l2', 3, 'k32')},
{_knn('l2', 'l1', 2, 'k21')},
{chosen},
lv3 AS (SELECT owner_id, parent_id AS query_id, 3 AS level, child_rank AS r3, 0 AS r2, 0 AS r1,
               child_id AS mem_id FROM t3),
lv2 AS (SELECT a.owner_id, a.parent_id AS query_id, 2 AS level, a.child_rank AS r3, b.child_rank AS r2, 0 AS r1, b.child_id AS mem_id
        FROM chosen a JOIN k32 b ON a.owner_id = b.owner_id AND a.child_id = b.parent_id),
lv1 AS (SELECT a.owner_id, a.query_id, 1 AS level, a.r3, a.r2, b.child_rank AS r1, b.child_id AS mem_id
        FROM lv2 a JOIN k21 b ON a.owner_id = b.owner_id AND a.mem_id = b.parent_id),
hits AS (SELECT owner_id, query_id, CAST(level AS INTEGER) AS level, CAST(r3 AS INTEGER) AS r3, CAST(r2 AS INTEGER) AS r2,
       CAST(r1 AS INTEGER) AS r1, mem_id
FROM (SELECT * FROM lv3 UNION ALL SELECT * FROM lv2 UNION ALL SELECT * FROM lv1))"""


# What the judge's four answers accept: 1 and 3; 2; nothing (a refusal); nothing.
_CHOSEN = """sel AS (SELECT vec_id AS query_id, unnest(CASE WHEN label % 4 = 0 THEN [1, 3] WHEN label % 4 = 1 THEN [2] ELSE [] END) AS rank FROM embeddings),
chosen AS (SELECT t3.* FROM t3 WHERE EXISTS (SELECT 1 FROM sel WHERE sel.query_id = t3.parent_id AND sel.rank = t3.child_rank)
             OR (t3.child_rank <= 2 AND NOT EXISTS (SELECT 1 FROM sel WHERE sel.query_id = t3.parent_id)))"""

ORACLE["hierarchical_selected"] = f"""WITH {MEMS},
{_drill(_CHOSEN)}
SELECT * FROM hits"""

ORACLE["hierarchical_text"] = f"""WITH {MEMS},
{_drill(_CHOSEN)},
ln AS (SELECT h.*, row_number() OVER (PARTITION BY h.owner_id, query_id ORDER BY h.level DESC, r3, r2, r1) AS i,
              '[' || coalesce(mm.ts_text, 'Unknown date') || '] ' || mm.attribute AS line
       FROM hits h JOIN mm ON mm.mem_id = h.mem_id)
SELECT owner_id, query_id, string_agg(CAST(i AS VARCHAR) || '. ' || line, chr(10) ORDER BY i) AS memory_text,
       CAST(count(*) AS INTEGER) AS n_lines FROM ln GROUP BY owner_id, query_id"""

ORACLE["routed_search"] = f"""WITH {MEMS},
rm AS (SELECT 'o' || CAST(mem_id % 3 AS VARCHAR) AS owner, mem_id, emb, ts_text, lower(attribute) AS low,
              mem_id % 3 = 0 OR (mem_id % 3 = 1 AND label <> 9) AS has FROM mm),
own AS (SELECT owner, bool_and(has) AS whole, min(epoch_us(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S'))) AS lo,
               max(epoch_us(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S'))) AS hi FROM rm GROUP BY owner),
v AS (SELECT q.owner, q.mem_id AS query_id, m.mem_id, 'vectors' AS route,
             0.85 * list_cosine_similarity(q.emb, m.emb)
             + 0.15 * coalesce((epoch_us(try_strptime(m.ts_text, '%Y-%m-%d %H:%M:%S')) - lo)::DOUBLE / CASE WHEN hi = lo THEN 1000000 ELSE hi - lo END, 0.0) AS score
      FROM rm q JOIN rm m USING (owner) JOIN own USING (owner) WHERE whole),
qw AS (SELECT DISTINCT owner, mem_id AS query_id, w FROM rm JOIN own USING (owner), unnest(regexp_extract_all(low, {_q(NONWS)})) AS u(w) WHERE NOT whole),
k AS (SELECT m.owner, qw.query_id, m.mem_id, 'words' AS route, count(*)::DOUBLE AS score
      FROM qw JOIN rm m ON m.owner = qw.owner AND contains(m.low, qw.w) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner, query_id ORDER BY score DESC, mem_id) AS INTEGER) AS rank
      FROM (SELECT * FROM v UNION ALL SELECT * FROM k))
SELECT owner AS owner_id, query_id, rank, mem_id, route FROM r WHERE rank <= 6"""

ORACLE["reuse_gate"] = """WITH RECURSIVE w AS (
  SELECT a.vec_id AS seq, CASE WHEN a.vec_id % 3 = 0 THEN -1 ELSE a.vec_id // 50 END AS session_id,
         list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * 0.4::DOUBLE + p[2]::DOUBLE) AS e, a.embedding[1] > -0.1 AS v
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 4),
q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM w),
g(session_id, rn, seq, ref, reused) AS (
  SELECT session_id, rn, seq, e, false FROM q WHERE rn = 1
  UNION ALL
  SELECT q.session_id, q.rn, q.seq,
         CASE WHEN q.v AND list_cosine_similarity(g.ref, q.e) > 0.7 THEN g.ref ELSE q.e END,
         q.v AND list_cosine_similarity(g.ref, q.e) > 0.7
  FROM g JOIN q ON q.session_id = g.session_id AND q.rn = g.rn + 1)
SELECT 'events' AS owner_id, CAST(session_id AS BIGINT) AS session_id, seq, reused FROM g"""

ORACLE["query_window"] = """SELECT 'convs' AS owner_id, conv_id AS session_id, turn AS seq,
       array_to_string(list(CASE WHEN suffix(text, '/n Me: ') THEN left(text, length(text) - 7) ELSE text END)
                       OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
                       chr(10) || chr(10)) AS query_text
FROM conversations WHERE role = 'user'"""


# --------------------------------------------------------------------------
# Ingest
# --------------------------------------------------------------------------

from chatlake.operators import ingest as _ing  # noqa: E402
from chatlake.sources import exports as _src  # noqa: E402

EM = """em AS (
  SELECT 'events' AS owner_id, CAST(user_id AS VARCHAR) AS thread_id, event_id AS seq,
         date_trunc('second', ts) AS ts,
         CASE WHEN event_type = 'click' THEN 'Me'
              WHEN event_type = 'view' THEN '+1212555' || lpad(CAST(user_id AS VARCHAR), 4, '0')
              ELSE event_type END AS speaker,
         CASE WHEN event_type = 'error' AND CAST(printf('%.2f', value) AS DOUBLE) < 5 THEN 'Edited to ' ELSE '' END
           || event_type || ' ' || printf('%.2f', value) AS content,
         value > 100.0 AS is_reply
  FROM events)"""

EXPORT_LINES = f"""{EM},
el0 AS (SELECT owner_id, thread_id, seq, k, parts[k] AS value FROM (
         SELECT *, list_filter([strftime(ts, '%b %-d, %Y  %-I:%M:%S %p'), speaker, content,
                                CASE WHEN is_reply THEN {_q(_src.REPLY_LINE)} END, ''],
                               lambda x: x IS NOT NULL) AS parts FROM em) s,
       range(1, len(parts) + 1) AS r(k)),
el AS (SELECT owner_id, thread_id, row_number() OVER (PARTITION BY owner_id, thread_id ORDER BY seq, k) AS line_no, value
       FROM el0),
cfx AS (SELECT 'events' AS owner_id, '212555' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phone_norm,
               c_name AS name
        FROM customer WHERE c_custkey IN (SELECT DISTINCT user_id FROM events) AND c_custkey % 2 = 0),
cm AS (SELECT map_from_entries(list({{'key': phone_norm, 'value': name}})) AS mp FROM cfx)"""


def _adv(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) = 11 AND starts_with({d}, '1') THEN substr({d}, 2) ELSE {d} END"


def _resolve(text: str, pat: str = _ing.CONTACT_PHONE_RE) -> str:
    pieces = f"regexp_split_to_array({text}, {_q(pat)})"
    ms = f"regexp_extract_all({text}, {_q(pat)})"
    return (f"array_to_string(list_transform(range(1, len({pieces}) + 1), lambda i: {pieces}[i] || "
            f"coalesce(coalesce(mp[{_adv(ms + '[i]')}], {ms}[i]), '')), '')")


RESOLVED = f"""{EXPORT_LINES},
rl AS (SELECT owner_id, thread_id, line_no, {_resolve('value')} AS value FROM el, cm)"""

ORACLE["parse_exports"] = f"""WITH {EM}
SELECT owner_id, thread_id, strftime(ts, {TS_FMT}) AS ts, speaker, content, is_reply,
       CASE WHEN is_reply THEN {_q(_src.REPLY_LINE)} END AS reply_info
FROM em WHERE NOT starts_with(content, 'Edited to')"""

ORACLE["thread_filter"] = f"""WITH {EM}
SELECT owner_id, thread_id, bool_or(speaker = 'Me') AS has_me, count(*) AS n_messages,
       count(*) > 20 AND bool_or(speaker = 'Me') AS keep
FROM em GROUP BY owner_id, thread_id"""

ORACLE["export_resolve"] = f"""WITH {RESOLVED}
SELECT owner_id, thread_id, line_no, value FROM rl"""

ORACLE["unmatched_numbers"] = f"""WITH {RESOLVED},
nx AS (SELECT owner_id, value AS v, lead(value) OVER (PARTITION BY owner_id, thread_id ORDER BY line_no) AS nxt FROM rl)
SELECT owner_id, nxt AS phone, count(*) AS n FROM nx
WHERE regexp_matches(v, {_q('^' + _src.EXPORT_TS_RE)}) AND regexp_matches(nxt, {_q(_ing.UNMATCHED_PHONE_RE)})
GROUP BY owner_id, nxt HAVING count(*) >= 10"""

ORACLE["speaker_census"] = f"""WITH {RESOLVED},
nx AS (SELECT owner_id, value AS v, lead(value) OVER (PARTITION BY owner_id, thread_id ORDER BY line_no) AS nxt FROM rl),
sp AS (SELECT DISTINCT owner_id, nxt AS speaker FROM nx
       WHERE regexp_matches(v, {_q(_src.EXPORT_TS_RE)}) AND nxt <> '' AND nxt <> 'Tapbacks:'
         AND NOT starts_with(nxt, 'Find My:'))
SELECT owner_id, CASE WHEN regexp_matches(speaker, {_q(_ing.CENSUS_PHONE_RE)}) THEN 'phone'
                      WHEN speaker = 'Me' THEN 'me' ELSE 'name' END AS category,
       count(*) AS n_speakers, array_to_string(list_sort(list(speaker)), ', ') AS speakers
FROM sp GROUP BY ALL"""

PHONE_DOCS = """pd AS (SELECT doc_id, regexp_replace(text, '\\+1 \\(([0-9]{3})\\) ([0-9]{3})-([0-9]{4})', '+1\\1\\2\\3', 'g') AS text
       FROM documents)"""

ORACLE["phone_normalize"] = f"""WITH {PHONE_DOCS},
x AS (SELECT doc_id, regexp_extract_all(text, {_q(_ing.CONTACT_PHONE_RE)}) AS ms FROM pd)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ms[i] AS raw, regexp_replace(ms[i], '[^0-9]', '', 'g') AS basic,
       {_adv('ms[i]')} AS advanced
FROM x, range(1, len(ms) + 1) AS r(i)"""

ORACLE["phone_resolve"] = f"""WITH {PHONE_DOCS},
found AS (SELECT DISTINCT regexp_replace(p, '[^0-9]', '', 'g') AS digits FROM documents,
          unnest(regexp_extract_all(text, '\\+1 \\([0-9]{{3}}\\) [0-9]{{3}}-[0-9]{{4}}')) AS u(p)),
cfx AS (SELECT {_adv('digits')} AS phone_norm, c_name AS name FROM found
        JOIN customer ON c_custkey = CAST(right(digits, 2) AS BIGINT)
        WHERE CAST(right(digits, 1) AS INTEGER) % 2 = 0),
cm AS (SELECT map_from_entries(list({{'key': phone_norm, 'value': name}})) AS mp FROM cfx)
SELECT doc_id, {_resolve('text')} AS resolved FROM pd, cm"""

MERGE_SQL = """sz AS (SELECT conv_id, role = 'assistant' AS is_b, sum(strlen(text) + 1) AS n FROM conversations
       GROUP BY ALL),
a AS (SELECT conv_id, n AS bytes_a FROM sz WHERE NOT is_b), b AS (SELECT conv_id, n AS bytes_b FROM sz WHERE is_b),
j AS (SELECT 'convs' AS owner_id, CAST(coalesce(a.conv_id, b.conv_id) AS VARCHAR) AS thread_id,
             CAST(bytes_a AS BIGINT) AS bytes_a, CAST(bytes_b AS BIGINT) AS bytes_b
      FROM a FULL JOIN b ON a.conv_id = b.conv_id),
d AS (SELECT *, CASE WHEN bytes_b IS NULL THEN 'a' WHEN bytes_a IS NULL THEN 'b'
                     WHEN bytes_a > bytes_b THEN 'a' ELSE 'b' END AS take FROM j)"""

ORACLE["merge_exports"] = f"""WITH {MERGE_SQL}
SELECT owner_id, thread_id, bytes_a, bytes_b, take,
       CASE WHEN bytes_b IS NULL THEN 'only_a' WHEN bytes_a IS NULL THEN 'only_b' ELSE 'common_' || take END AS status
FROM d"""

ORACLE["merge_report"] = f"""WITH {MERGE_SQL}
SELECT CASE WHEN bytes_b IS NULL THEN 'only_a' WHEN bytes_a IS NULL THEN 'only_b' ELSE 'common_' || take END AS status,
       count(*) AS n FROM d GROUP BY 1"""

ORACLE["participant_rank"] = """SELECT event_type AS participant, count(DISTINCT user_id) AS n_threads,
       row_number() OVER (ORDER BY count(DISTINCT user_id), event_type) AS rank
FROM events WHERE value > 100 GROUP BY event_type"""

_SIDE = """{n}0 AS (SELECT owner_id, thread_id, seq, k, parts[k] AS value FROM (
         SELECT *, list_filter([strftime(ts, '%b %-d, %Y  %-I:%M:%S %p'), speaker, content,
                                CASE WHEN is_reply THEN 'This message responded to an earlier message.' END, ''],
                               lambda x: x IS NOT NULL) AS parts
         FROM em WHERE CAST(thread_id AS BIGINT) % {t} <> 0 AND (CAST(thread_id AS BIGINT) % 7 = 0 OR seq % 3 <> {m})) s,
       range(1, len(parts) + 1) AS r(k)),
{n} AS (SELECT owner_id, thread_id, row_number() OVER (PARTITION BY owner_id, thread_id ORDER BY seq, k) AS line_no, value, '{n}' AS export
       FROM {n}0),
z{n} AS (SELECT owner_id, thread_id, sum(strlen(value) + 1) AS n FROM {n} GROUP BY ALL)"""

ORACLE["merged_threads"] = f"""WITH {EM},
{_SIDE.format(n='a', t=5, m=0)},
{_SIDE.format(n='b', t=4, m=1)},
tk AS (SELECT owner_id, thread_id, CASE WHEN zb.n IS NULL OR za.n > zb.n THEN 'a' ELSE 'b' END AS export
       FROM za FULL JOIN zb USING (owner_id, thread_id))
SELECT x.owner_id, x.thread_id, x.line_no, x.value, x.export
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x JOIN tk USING (owner_id, thread_id, export)"""


# --------------------------------------------------------------------------
# Memory bank
# --------------------------------------------------------------------------

import re as _re  # noqa: E402

from chatlake import prompts as _prompts  # noqa: E402
from chatlake.operators import memory as _mem  # noqa: E402


def _template_sql(template: str, **kw) -> str:
    parts, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        parts.append(_q(template[pos:m.start()]))
        parts.append(kw[m.group(1)])
        pos = m.end()
    parts.append(_q(template[pos:]))
    return " || ".join(parts)


def _doc_resp(name: str, cases: str, mod: int) -> str:
    return f"""{name} AS (SELECT 'events' AS owner_id, doc_id AS batch_no,
  array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    CASE (i - 1 + doc_id) % {mod} {cases} END), chr(10)) AS text FROM documents)"""


EX_RESP = _doc_resp("exr", """
    WHEN 0 THEN '- Attribute: ' || l
    WHEN 1 THEN '- Citation: Conversation ' || CAST(length(l) % 23 + 1 AS VARCHAR) || ', Me: ' || l
    WHEN 2 THEN '- Timestamp: 2023-05-' || lpad(CAST(length(l) % 28 + 1 AS VARCHAR), 2, '0') || ' 14:30'
    WHEN 3 THEN '• Attribute: ' || l
    WHEN 4 THEN 'Timestamp: ' || l
    WHEN 5 THEN l
    ELSE 'citation: see the conversation'""", 7)

CB_RESP = _doc_resp("cbr", """
    WHEN 0 THEN 'COMBINED ATTRIBUTES:'
    WHEN 1 THEN '- Attribute: ' || l
    WHEN 2 THEN '- Based on: Attribute ' || CAST(length(l) % 30 + 1 AS VARCHAR) || ', Attribute '
                || CAST(length(l) % 7 + 1 AS VARCHAR)
    WHEN 3 THEN 'INFERRED ATTRIBUTES:'
    WHEN 4 THEN '• Attribute: ' || l
    ELSE 'Based on: ' || l""", 6)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(STRIP)}, '', 'g')"


def _resp_lines(src: str, name: str) -> str:
    return f"""{name}_p AS (SELECT owner_id, batch_no, p.i AS pos, {_strip('parts[p.i]')} AS raw
       FROM (SELECT owner_id, batch_no, string_split({_strip('text')}, chr(10)) AS parts FROM {src}) s,
            range(1, len(parts) + 1) AS p(i)),
{name} AS (SELECT owner_id, batch_no, pos, raw,
              CASE WHEN starts_with(raw, '- ') OR starts_with(raw, '• ') THEN substr(raw, 3) ELSE raw END AS line
       FROM {name}_p WHERE raw <> '')"""


ATTR_PARSE = f"""{EX_RESP},
{_resp_lines('exr', 'xl')},
xk0 AS (SELECT owner_id, batch_no, pos,
           CASE WHEN starts_with(lower(line), 'attribute:') THEN 'A'
                WHEN starts_with(lower(line), 'citation:') THEN 'C'
                WHEN starts_with(lower(line), 'timestamp:') THEN 'T' END AS kind,
           CASE WHEN starts_with(lower(line), 'attribute:') THEN {_strip('substr(line, 11)')}
                WHEN starts_with(lower(line), 'citation:') THEN {_strip('substr(line, 10)')}
                ELSE {_strip('substr(line, 11)')} END AS val
       FROM xl),
xk AS (SELECT *, row_number() OVER (PARTITION BY owner_id, batch_no ORDER BY pos) AS i FROM xk0 WHERE kind IS NOT NULL),
rc(owner_id, batch_no, i, rec, has, attr, cit, ts, e_rec, e_attr, e_cit, e_ts, emitted) AS (
  SELECT DISTINCT owner_id, batch_no, 0, 0, false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR,
         NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false FROM xk
  UNION ALL
  SELECT r.owner_id, r.batch_no, k.i,
         CASE WHEN k.kind = 'A' THEN r.rec + 1 ELSE r.rec END,
         CASE WHEN k.kind = 'A' THEN true WHEN k.kind = 'T' AND r.has AND r.cit IS NOT NULL THEN false ELSE r.has END,
         CASE WHEN k.kind = 'A' THEN k.val WHEN k.kind = 'T' AND r.has AND r.cit IS NOT NULL THEN NULL ELSE r.attr END,
         CASE WHEN k.kind = 'A' THEN NULL WHEN k.kind = 'C' AND r.has THEN k.val
              WHEN k.kind = 'T' AND r.has AND r.cit IS NOT NULL THEN NULL ELSE r.cit END,
         CASE WHEN k.kind = 'A' THEN NULL WHEN k.kind = 'T' AND r.has AND r.cit IS NOT NULL THEN NULL
              WHEN k.kind = 'T' AND r.has THEN k.val ELSE r.ts END,
         r.rec, r.attr, r.cit, CASE WHEN k.kind = 'T' THEN k.val ELSE r.ts END,
         (k.kind = 'A' AND r.has) OR (k.kind = 'T' AND r.has AND r.cit IS NOT NULL)
  FROM rc r JOIN xk k ON k.owner_id = r.owner_id AND k.batch_no = r.batch_no AND k.i = r.i + 1),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, batch_no ORDER BY i DESC) AS rn FROM rc)
        WHERE rn = 1 AND has),
attrs AS (
  SELECT owner_id, batch_no, e_rec AS rec, e_attr AS attribute, e_cit AS citation, e_ts AS timestamp FROM rc WHERE emitted
  UNION ALL
  SELECT owner_id, batch_no, rec, attr, coalesce(cit, ''), coalesce(ts, '') FROM fin),
attrs2 AS (SELECT *, CASE WHEN regexp_extract(lower(citation), {_q(_mem.CONV_NUM_RE)}, 1) <> ''
                          THEN CAST(regexp_extract(lower(citation), {_q(_mem.CONV_NUM_RE)}, 1) AS INTEGER) END
                     AS conversation_number FROM attrs),
packed AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY batch_no, rec) - 1 AS seq_no FROM attrs2),
packed2 AS (SELECT *, seq_no // 25 AS cbatch, CAST(seq_no % 25 + 1 AS INTEGER) AS cslot FROM packed)"""

COMB_PARSE = f"""{CB_RESP},
{_resp_lines('cbr', 'bl')},
bk0 AS (SELECT owner_id, batch_no, pos,
           CASE WHEN contains(upper(raw), 'COMBINED ATTRIBUTES') THEN 'H'
                WHEN contains(upper(raw), 'INFERRED ATTRIBUTES') THEN 'H'
                WHEN starts_with(lower(line), 'attribute:') THEN 'A'
                WHEN starts_with(lower(line), 'based on:') THEN 'B' END AS kind,
           CASE WHEN contains(upper(raw), 'COMBINED ATTRIBUTES') THEN 'combined'
                WHEN contains(upper(raw), 'INFERRED ATTRIBUTES') THEN 'inferred'
                WHEN starts_with(lower(line), 'attribute:') THEN {_strip('substr(line, 11)')}
                ELSE {_strip('substr(line, 10)')} END AS val
       FROM bl),
bk AS (SELECT *, row_number() OVER (PARTITION BY owner_id, batch_no ORDER BY pos) AS i FROM bk0 WHERE kind IS NOT NULL),
rb(owner_id, batch_no, i, sec, rec, has, attr, e_rec, e_sec, e_attr, e_based, emitted) AS (
  SELECT DISTINCT owner_id, batch_no, 0, NULL::VARCHAR, 0, false, NULL::VARCHAR,
         NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false FROM bk
  UNION ALL
  SELECT r.owner_id, r.batch_no, k.i,
         CASE WHEN k.kind = 'H' THEN k.val ELSE r.sec END,
         CASE WHEN k.kind = 'A' THEN r.rec + 1 ELSE r.rec END,
         CASE WHEN k.kind = 'A' THEN true WHEN k.kind = 'B' AND r.has THEN false ELSE r.has END,
         CASE WHEN k.kind = 'A' THEN k.val WHEN k.kind = 'B' AND r.has THEN NULL ELSE r.attr END,
         r.rec, r.sec, r.attr, CASE WHEN k.kind = 'B' THEN k.val END,
         (k.kind = 'A' AND r.has) OR (k.kind = 'B' AND r.has)
  FROM rb r JOIN bk k ON k.owner_id = r.owner_id AND k.batch_no = r.batch_no AND k.i = r.i + 1),
bfin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, batch_no ORDER BY i DESC) AS rn FROM rb)
         WHERE rn = 1 AND has),
comb AS (
  SELECT owner_id, batch_no, e_rec AS rec, e_sec AS kind, e_attr AS attribute, e_based AS based_on
  FROM rb WHERE emitted AND e_sec IS NOT NULL
  UNION ALL
  SELECT owner_id, batch_no, rec, sec, attr, '' FROM bfin WHERE sec IS NOT NULL)"""

ORACLE["parse_attributes"] = f"""WITH RECURSIVE {ATTR_PARSE}
SELECT owner_id, batch_no, rec, attribute, citation, timestamp, conversation_number FROM attrs2"""

ORACLE["parse_combined"] = f"""WITH RECURSIVE {COMB_PARSE}
SELECT owner_id, batch_no, rec, kind, attribute, based_on FROM comb"""

STORE_BATCH = f"""{store_ctes(M_EVENTS, 1000, 2, 75)},
sb AS (SELECT *, CAST((store_rank - 1) // 20 AS BIGINT) AS batch_no,
              CAST((store_rank - 1) % 20 + 1 AS INTEGER) AS slot FROM store)"""

ORACLE["pack_batches"] = f"""WITH {STORE_BATCH}
SELECT owner_id, thread_id, conv_no, store_rank, batch_no, slot FROM sb"""

ORACLE["extract_requests"] = f"""WITH {STORE_BATCH},
blk AS (SELECT sb.owner_id, sb.batch_no, sb.slot,
               'CONVERSATION ' || CAST(sb.slot AS VARCHAR) || ' START:' || chr(10)
               || string_agg(strftime(t.ts, {TS_FMT}) || ' ' || t.speaker || ': ' || t.content || chr(10), ''
                             ORDER BY t.turn_idx)
               || 'CONVERSATION ' || CAST(sb.slot AS VARCHAR) || ' END' || chr(10) AS block
        FROM sb JOIN t USING (owner_id, thread_id, conv_no) GROUP BY sb.owner_id, sb.batch_no, sb.slot),
g AS (SELECT owner_id, batch_no, count(*) AS n, string_agg(block, chr(10) ORDER BY slot) AS convs
      FROM blk GROUP BY owner_id, batch_no)
SELECT owner_id, 'extract' AS stage, batch_no,
       {_template_sql(_prompts.EXTRACT_PROMPT, n='CAST(n AS VARCHAR)', person="'Me'", convs='convs')} AS prompt
FROM g"""

ORACLE["link_conversations"] = f"""WITH RECURSIVE {STORE_BATCH},
{ATTR_PARSE}
SELECT a.owner_id, a.batch_no, a.rec, a.conversation_number, sb.thread_id, sb.conv_no
FROM attrs2 a LEFT JOIN sb ON sb.owner_id = a.owner_id AND sb.batch_no = a.batch_no
                          AND sb.slot = a.conversation_number"""

NEAREST = f"""nb AS (SELECT owner_id, cbatch,
              list(CASE WHEN {_strip("coalesce(timestamp, '')")} <> '' THEN timestamp END ORDER BY cslot) AS tl
       FROM packed2 GROUP BY owner_id, cbatch),
nt AS (SELECT p.*, n.tl, least(p.cslot - 1, len(n.tl) - p.cslot) AS lim FROM packed2 p JOIN nb n USING (owner_id, cbatch)),
nd AS (SELECT *, list_filter(range(0, lim + 1), lambda d: tl[cslot + d] IS NOT NULL OR tl[cslot - d] IS NOT NULL)[1]
              AS d0 FROM nt),
nr AS (SELECT *, CASE WHEN d0 IS NULL THEN '' ELSE coalesce(tl[cslot + d0], tl[cslot - d0]) END AS prompt_ts FROM nd)"""

ORACLE["nearest_timestamp"] = f"""WITH RECURSIVE {ATTR_PARSE},
{NEAREST}
SELECT owner_id, seq_no, cbatch, cslot, timestamp, prompt_ts FROM nr"""

ORACLE["combine_requests"] = f"""WITH RECURSIVE {ATTR_PARSE},
{NEAREST},
g AS (SELECT owner_id, cbatch,
             string_agg('Attribute ' || CAST(cslot AS VARCHAR) || ': ' || attribute || ' (Citation: '
                        || coalesce(citation, '') || ', Timestamp: ' || prompt_ts || ')', chr(10) ORDER BY cslot) AS attrs
      FROM nr GROUP BY owner_id, cbatch)
SELECT owner_id, 'combine' AS stage, cbatch AS batch_no,
       {_template_sql(_prompts.COMBINE_PROMPT, person="'Me'", attrs='attrs')} AS prompt FROM g"""

ORACLE["resolve_sources"] = f"""WITH RECURSIVE {ATTR_PARSE},
{COMB_PARSE},
refs AS (SELECT c.owner_id, c.batch_no, c.rec, c.kind, CAST(j.o - 1 AS INTEGER) AS ord,
                CAST(regexp_extract_all(coalesce(c.based_on, ''), {_q(_mem.ATTR_REF_RE)}, 1)[j.o] AS INTEGER) AS cslot
         FROM comb c, range(1, len(regexp_extract_all(coalesce(c.based_on, ''), {_q(_mem.ATTR_REF_RE)}, 1)) + 1) AS j(o))
SELECT r.owner_id, r.batch_no, r.rec, r.kind, r.ord, r.cslot, p.seq_no AS source_seq
FROM refs r JOIN packed2 p ON p.owner_id = r.owner_id AND p.cbatch = r.batch_no AND p.cslot = r.cslot"""

ORACLE["unify_memories"] = f"""WITH RECURSIVE {ATTR_PARSE},
{COMB_PARSE},
u AS (SELECT owner_id, 0 AS ko, seq_no AS k1, 0 AS k2, 'Original Attribute' AS type, attribute,
             coalesce(citation, '') AS citation FROM packed2
      UNION ALL
      SELECT owner_id, CASE WHEN kind = 'combined' THEN 1 ELSE 2 END, batch_no, rec,
             CASE WHEN kind = 'combined' THEN 'Combined Attribute' ELSE 'Inferred Attribute' END, attribute,
             coalesce(based_on, '') FROM comb)
SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY ko, k1, k2) AS id, type, attribute, citation FROM u"""

EV_RESP = """evr AS (SELECT 'events' AS owner_id, doc_id AS batch_no,
  CASE WHEN doc_id % 5 = 0 THEN (CASE WHEN doc_id % 10 = 0 THEN 'No memories could be created.'
                                      ELSE '[{"attribute": "unterminated' END)
       ELSE 'Here are the memories:' || chr(10) || '[' || array_to_string(list_transform(string_split(text, chr(10)),
              lambda l, i: CAST(json_object('attribute', l, 'citation', 'Original Attribute ' || CAST(i AS VARCHAR),
                                            'timestamp', 'Summer 2023') AS VARCHAR)), ',' || chr(10))
            || ']' || chr(10) || 'Done.' END AS text
  FROM documents),
eva AS (SELECT *, regexp_extract(text, '(?s)(\\[.*\\])', 1) AS arr FROM evr),
evok AS (SELECT owner_id, batch_no,
                from_json(arr, '[{"attribute":"VARCHAR","citation":"VARCHAR","timestamp":"VARCHAR"}]') AS items
         FROM eva WHERE arr <> '' AND json_valid(arr)),
evm AS (SELECT owner_id, batch_no, CAST(j.i - 1 AS INTEGER) AS pos, items[j.i].attribute AS attribute,
               items[j.i].citation AS citation, items[j.i].timestamp AS timestamp
        FROM evok, range(1, len(items) + 1) AS j(i))"""

ORACLE["json_memories"] = f"""WITH {EV_RESP}
SELECT owner_id, batch_no, pos, attribute, citation, timestamp FROM evm"""

ORACLE["json_rejects"] = f"""WITH {EV_RESP}
SELECT owner_id, batch_no FROM eva WHERE arr = '' OR NOT json_valid(arr)"""

ORACLE["top_memories"] = f"""WITH {EV_RESP},
tr AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY batch_no, pos) AS INTEGER) AS top_rank FROM evm)
SELECT owner_id, top_rank, batch_no, pos, attribute FROM tr WHERE top_rank <= 25"""


def _pts(x: str) -> str:
    return f"coalesce(try_strptime({x}, '%Y-%m-%d %H:%M:%S'), try_strptime({x}, '%Y-%m-%d %H:%M'))"


BANK = f"""{ATTR_PARSE},
{COMB_PARSE},
{EV_RESP},
edges AS (
  SELECT c.owner_id, 2305843009213693952 + c.batch_no * 16777216 + c.rec AS mem_id, j.o - 1 AS ord,
         CAST(regexp_extract_all(coalesce(c.based_on, ''), {_q(_mem.ATTR_REF_RE)}, 1)[j.o] AS INTEGER) AS cslot,
         c.batch_no
  FROM comb c, range(1, len(regexp_extract_all(coalesce(c.based_on, ''), {_q(_mem.ATTR_REF_RE)}, 1)) + 1) AS j(o)),
srcs AS (SELECT e.owner_id, e.mem_id, e.ord, p.timestamp AS source_ts FROM edges e
         JOIN packed2 p ON p.owner_id = e.owner_id AND p.cbatch = e.batch_no AND p.cslot = e.cslot),
bank AS (
  SELECT owner_id, seq_no + 1 AS mem_id, 1 AS level, attribute, citation, timestamp AS ts_text FROM packed2
  UNION ALL
  SELECT owner_id, 2305843009213693952 + batch_no * 16777216 + rec, 2, attribute, based_on, NULL FROM comb
  UNION ALL
  SELECT owner_id, 4611686018427387904 + row_number() OVER (PARTITION BY owner_id ORDER BY batch_no, pos), 3,
         attribute, citation, timestamp FROM evm
  QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY batch_no, pos) <= 25)"""

# Original memories with the conversation that their citation names, and each memory's place in time.
LINKED = f"""{STORE_BATCH},
{BANK},
lnk AS (SELECT p.owner_id, p.seq_no + 1 AS mem_id, sb.thread_id, sb.conv_no FROM packed2 p
        JOIN sb ON sb.owner_id = p.owner_id AND sb.batch_no = p.batch_no AND sb.slot = p.conversation_number),
sx AS (SELECT e.owner_id, e.mem_id, e.ord, p.seq_no + 1 AS source_mem_id, p.timestamp AS source_ts,
              p.seq_no + 1 IN (SELECT mem_id FROM lnk) AS source_has FROM edges e
       JOIN packed2 p ON p.owner_id = e.owner_id AND p.cbatch = e.batch_no AND p.cslot = e.cslot),
sg AS (SELECT owner_id, mem_id, min({_pts('source_ts')}) AS sts, bool_or(source_has) AS shc FROM sx GROUP BY ALL),
tl AS (SELECT b.owner_id, b.mem_id, b.attribute, b.level,
              CASE WHEN level = 1 THEN 'original' ELSE (SELECT c.kind FROM comb c WHERE c.owner_id = b.owner_id
                   AND 2305843009213693952 + c.batch_no * 16777216 + c.rec = b.mem_id) END AS kind,
              b.ts_text IS NOT NULL AS own, CASE WHEN b.ts_text IS NOT NULL THEN {_pts('b.ts_text')} ELSE sg.sts END AS tl_ts,
              (level = 1 AND b.mem_id IN (SELECT mem_id FROM lnk)) OR coalesce(shc, false) AS has_conversation
       FROM bank b LEFT JOIN sg USING (owner_id, mem_id) WHERE level < 3),
tli AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY tl_ts DESC NULLS LAST,
                                     CASE kind WHEN 'original' THEN 0 WHEN 'combined' THEN 1 ELSE 2 END, mem_id) - 1 AS tl_index,
               coalesce(strftime(tl_ts, '%Y-%m-%d'), '0001-01-01') AS day
        FROM tl WHERE own OR tl_ts IS NOT NULL)"""

ORACLE["timeline_days"] = f"""WITH RECURSIVE {LINKED}
SELECT owner_id, day, count(*) AS n_memories, string_agg(attribute, ' | ' ORDER BY tl_index) AS attributes
FROM tli GROUP BY ALL"""

ORACLE["timeline_rows"] = f"""WITH RECURSIVE {LINKED}
SELECT owner_id, tl_index, day, strftime(tl_ts, {TS_FMT}) AS tl_ts, mem_id, kind, attribute, has_conversation FROM tli"""

_BANK_ROWS = """be AS (SELECT source AS owner_id, doc_id AS pos, left(text, 60) AS attribute, doc_id % 7 AS f, lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS dd,
       CASE doc_id % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'combined' WHEN 2 THEN 'inferred' ELSE 'top' END AS kind,
       CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS level FROM documents),
bv AS (SELECT owner_id, kind, level, CAST(row_number() OVER (PARTITION BY owner_id, kind ORDER BY pos) - 1 AS INTEGER) AS pos, attribute, f,
              CASE WHEN f = 0 THEN '2023-05-' || dd || ' 10:00:00' WHEN f = 1 THEN '2023-05-' || dd || ' 10:00' WHEN f = 6 THEN 'Summer 2023'
                   WHEN level = 3 THEN NULL WHEN f = 2 THEN '2022-01-' || dd || ' 09:00:00' WHEN f = 3 THEN '2021-03-' || dd || ' 8:15'
                   WHEN f = 4 THEN '2020-02-' || dd ELSE '' END AS timestamp,
              CASE WHEN f = 3 THEN 'said. Timestamp: 2021-03-' || dd || ' 8:15 there' WHEN f = 6 THEN 'c'
                   WHEN f = 4 THEN '["no time", "on 2020-02-' || dd || ' we", "Timestamp: 2019-01-01 10:00"]' ELSE '[]' END AS citations FROM be)"""

ORACLE["bank_views"] = f"""WITH {_BANK_ROWS}
SELECT v.view, owner_id, kind, CAST(level AS INTEGER) AS level, pos, attribute, timestamp, citations
FROM bv, (VALUES ('flat'), ('hierarchical')) v(view) WHERE v.view = 'hierarchical' OR level = 2"""

ORACLE["bank_counts"] = f"""WITH {_BANK_ROWS}
SELECT v.view, count(*) FILTER (WHERE v.view = 'hierarchical' OR level = 2) AS kept,
       count(*) FILTER (WHERE v.view = 'flat' AND level <> 2) AS dropped,
       count(*) FILTER (WHERE timestamp = '' AND (level = 2 OR v.view = 'hierarchical' AND level = 1)) AS undated
FROM bv, (VALUES ('flat'), ('hierarchical')) v(view) GROUP BY v.view"""

_UNIFIED = ORACLE["unify_memories"][len("WITH RECURSIVE "):].split("\nSELECT owner_id, row_number()")[0]
ORACLE["event_requests"] = f"""WITH RECURSIVE {_UNIFIED},
un AS (SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY ko, k1, k2) AS id, type, attribute, citation FROM u),
ch AS (SELECT owner_id, (id - 1) // 100 AS chunk, '[' || chr(10) || string_agg(
         '  {{' || chr(10) || '    "type": ' || CAST(to_json(type) AS VARCHAR) || ',' || chr(10) || '    "id": ' || CAST(id AS VARCHAR) || ',' || chr(10)
         || '    "content": ' || CAST(to_json(coalesce(attribute, '')) AS VARCHAR) || ',' || chr(10)
         || '    "citation": ' || CAST(to_json(citation) AS VARCHAR) || chr(10) || '  }}', ',' || chr(10) ORDER BY id) || chr(10) || ']' AS js
       FROM un GROUP BY ALL),
tot AS (SELECT owner_id, max(chunk) + 1 AS n FROM ch GROUP BY owner_id)
SELECT owner_id, 'events' AS stage, chunk AS batch_no,
       {_template_sql(_prompts.EVENT_PROMPT, person="'Me'", chunk='CAST(chunk + 1 AS VARCHAR)', total='CAST(n AS VARCHAR)', json='js')} AS prompt
FROM ch JOIN tot USING (owner_id)"""

ORACLE["recover_timestamps"] = f"""WITH RECURSIVE {BANK},
fs AS (SELECT owner_id, mem_id, arg_min(source_ts, ord) AS sts FROM srcs WHERE source_ts IS NOT NULL GROUP BY ALL)
SELECT b.owner_id, b.mem_id,
       CASE WHEN b.ts_text IS NOT NULL AND b.ts_text <> '' THEN b.ts_text
            ELSE coalesce(fs.sts,
                          nullif(regexp_extract(coalesce(b.citation, ''), {_q(_mem.TS_IN_CITATION_RE)}, 1), ''),
                          nullif(regexp_extract(coalesce(b.citation, ''), {_q(_mem.DATE_IN_CITATION_RE)}, 0), ''),
                          '') END AS recovered_ts
FROM bank b LEFT JOIN fs USING (owner_id, mem_id) WHERE b.level = 2"""


# --------------------------------------------------------------------------
# Example store, transcripts, templates, spans, phrase search
# --------------------------------------------------------------------------

from chatlake.operators import examples as _exm  # noqa: E402
from chatlake.operators.stats import TOKEN_RE as _TOK  # noqa: E402

ORACLE["partner_index"] = f"""WITH {turns_ctes(M_EVENTS)}
SELECT owner_id, thread_id, conv_no, lower(trim(max(speaker) FILTER (WHERE speaker <> 'Me'))) AS partner_key
FROM t GROUP BY owner_id, thread_id, conv_no
HAVING count(DISTINCT speaker) = 2 AND bool_or(speaker = 'Me')"""

def _draw(seed: int, of: str, n: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({of} AS VARCHAR)), 1, 8)) AS BIGINT) % {n}"


def _lookup(names: str) -> str:
    """``t`` and ``store`` -> ``pick``: the conversation for each row of ``names`` (query_id, name)."""
    return f"""pc AS (SELECT t.owner_id, t.thread_id, t.conv_no, store_rank, max(speaker) FILTER (WHERE speaker <> 'Me') AS partner
       FROM t JOIN store USING (owner_id, thread_id, conv_no) GROUP BY ALL
       HAVING count(DISTINCT speaker) = 2 AND bool_or(speaker = 'Me')),
pk AS (SELECT *, {_strip('lower(partner)')} AS partner_key FROM pc WHERE partner <> ''),
pp AS (SELECT partner_key, min(store_rank) AS first_rank, count(*) AS n_conv FROM pk GROUP BY partner_key),
pr AS (SELECT *, row_number() OVER (ORDER BY first_rank) - 1 AS pidx, count(*) OVER () AS n_part FROM pp),
nm AS ({names}),
ns AS (SELECT query_id, {_strip('lower(name)')} AS name FROM nm),
fd AS (SELECT query_id, min(pidx) AS hit FROM ns JOIN pr ON contains(partner_key, ns.name) GROUP BY query_id),
ch AS (SELECT query_id, hit IS NOT NULL AS matched, coalesce(hit, {_draw(7, 'query_id', '(SELECT max(n_part) FROM pr)')}) AS pidx
       FROM ns LEFT JOIN fd USING (query_id)),
cv AS (SELECT *, row_number() OVER (PARTITION BY partner_key ORDER BY store_rank) - 1 AS cidx FROM pk),
pick AS (SELECT cv.owner_id, ch.query_id, partner_key, matched, thread_id, conv_no
         FROM ch JOIN pr USING (pidx) JOIN cv USING (partner_key) WHERE cidx = {_draw(8, 'query_id', 'n_conv')})"""


_EXAMPLE_NAMES = """SELECT 'whole:' || t AS query_id, t AS name FROM (SELECT DISTINCT event_type AS t FROM events)
  UNION ALL SELECT 'padded:' || t, chr(32) || chr(9) || upper(t) || '  ' FROM (SELECT DISTINCT event_type AS t FROM events)
  UNION ALL SELECT 'cut:' || t, substr(t, 2, 3) FROM (SELECT DISTINCT event_type AS t FROM events)
  UNION ALL SELECT 'letter:' || t, right(t, 1) FROM (SELECT DISTINCT event_type AS t FROM events)
  UNION ALL SELECT n_name, n_name FROM nation UNION ALL SELECT 'blank:' || r_name, ' ' FROM region"""

ORACLE["partner_lookup"] = f"""WITH {store_ctes(M_EVENTS, 1000, 2, 75)},
{_lookup(_EXAMPLE_NAMES)}
SELECT * FROM pick"""

ORACLE["render_transcripts"] = f"""WITH {turns_ctes(M_EVENTS)}
SELECT owner_id, thread_id, conv_no,
       string_agg(strftime(ts, {TS_FMT}) || ' ' || speaker || ': ' || content, chr(10) ORDER BY turn_idx) AS transcript,
       CAST(count(*) AS INTEGER) AS n_turns
FROM t GROUP BY owner_id, thread_id, conv_no"""

ORACLE["unmerge_turns"] = f"""WITH {turns_ctes(M_EVENTS)},
s AS (SELECT *, string_split(content, '<|msg|>') AS parts FROM t)
SELECT owner_id, thread_id, conv_no, turn_idx, speaker, CAST(j.i - 1 AS INTEGER) AS part_idx,
       {_strip('parts[j.i]')} AS message
FROM s, range(1, len(parts) + 1) AS j(i)"""

_LABEL_NAMES = "SELECT vec_id AS query_id, CASE WHEN label % 3 = 0 THEN 'View ' WHEN label % 3 = 1 THEN 'purch' ELSE 'nobody' END AS name FROM embeddings"

ORACLE["system_prompt"] = f"""WITH {store_ctes(M_EVENTS, 1000, 2, 75)},
{_lookup(_LABEL_NAMES)},
tr AS (SELECT owner_id, thread_id, conv_no, string_agg(strftime(ts, {TS_FMT}) || ' ' || speaker || ': ' || content || chr(10), '' ORDER BY turn_idx) AS transcript
       FROM t GROUP BY owner_id, thread_id, conv_no),
ft AS ({ORACLE["flat_search_text"]})
SELECT mq.owner_id, mq.query_id,
  'Today''s date is 2024-02-01. You are a human being named Me. You are not an AI. Respond as yourself. You will first be given the topic of conversation, '
  || 'then any existing conversation history if there is any. Be sure to reply in the style of Me. Use the ''<|msg|>'' token to send mulitple messages at once if you wish. '
  || chr(10) || chr(10) || 'Here is an example conversation between Me and another individual. This conversation is not relevant to the current conversation. '
  || 'Use this conversation to help aid you to emulate stylistically on how to communicate in your conversations. ''Me'' is the user that you are imitating.'
  || chr(10) || chr(10) || ' [BEGIN EXAMPLE CONVERSATION]' || chr(10) || coalesce(transcript, 'None') || chr(10) || '[END EXAMPLE CONVERSATION]'
  || chr(10) || chr(10) || 'Here are some of your relevant memories + facts about yourself that may help you respond authentically. Pay careful attention to the date of the memories, '
  || 'as events have occurred in the past, and you should make reference to them in the appropriate time manner. ' || chr(10) || chr(10) || '[BEGIN MEMORIES]' || chr(10)
  || coalesce(memory_text, '') || chr(10) || '[END MEMORIES]' || chr(10) || chr(10) || 'Now you may begin the conversation.' AS system_message
FROM (SELECT 'events' AS owner_id, vec_id AS query_id FROM embeddings) mq
LEFT JOIN (SELECT pick.query_id, tr.transcript FROM pick JOIN tr USING (owner_id, thread_id, conv_no)) ex USING (query_id)
LEFT JOIN ft USING (query_id)"""

_LLAMA = _exm.CHAT_TEMPLATES["llama"]
_QWEN = _exm.CHAT_TEMPLATES["qwen"]


def _tpl(template: str, upto_output: bool = False) -> str:
    if upto_output:
        template = template[:template.index("{output}")]
    return _template_sql(template, instruction="instruction", input="input", output="output")


ORACLE["chat_template"] = f"""WITH {examples_ctes(M_CONV, max_words=200)}
SELECT owner_id, thread_id, conv_no, turn_idx, {_tpl(_LLAMA)} AS text, {_tpl(_LLAMA, True)} AS prompt_text
FROM xr WHERE reject_reason IS NULL"""

ORACLE["sft_spans"] = f"""WITH {examples_ctes(M_CONV, max_words=200)},
s AS (SELECT *, len(regexp_extract_all({_tpl(_QWEN)}, {_q(_TOK)})) AS nt,
             len(regexp_extract_all({_tpl(_QWEN, True)}, {_q(_TOK)})) AS np
      FROM xr WHERE reject_reason IS NULL)
SELECT owner_id, thread_id, conv_no, turn_idx, least(nt, 512) AS n_tokens,
       CAST(least(np, 512) AS INTEGER) AS prompt_len, least(nt, 512) - least(np, 512) AS n_label_tokens FROM s"""

_PIECE_ID = "list_transform(regexp_extract_all({t}, {p}), lambda w: CAST(('0x' || substr(md5(w), 1, 7)) AS INTEGER))"

ORACLE["sft_labels"] = f"""WITH {examples_ctes(M_CONV, max_words=200)},
s AS (SELECT *, {_PIECE_ID.format(t=_tpl(_LLAMA), p=_q(_TOK))}[1:512] AS ids,
             least(512, len(regexp_extract_all({_tpl(_LLAMA.replace('{output}', ''))}, {_q(_TOK)}))) AS np
      FROM xr WHERE reject_reason IS NULL)
SELECT owner_id, thread_id, conv_no, turn_idx, CAST(np AS INTEGER) AS prompt_length,
       array_to_string(ids, ' ') AS input_ids,
       array_to_string(list_transform(ids, lambda v, i: CASE WHEN i <= np THEN -100 ELSE v END), ' ') AS labels
FROM s"""

ORACLE["phrase_search"] = """SELECT d.doc_id, b.item_id AS phrase_id, 'text' AS field, right(d.text, 100) AS context
FROM documents d JOIN benchmark b ON b.text <> '' AND contains(lower(d.text), lower(b.text))"""

ORACLE["phrase_counts"] = """SELECT b.item_id AS phrase_id, b.text AS phrase, count(*) AS n_hits
FROM documents d JOIN benchmark b ON b.text <> '' AND contains(lower(d.text), lower(b.text)) GROUP BY ALL"""


# --------------------------------------------------------------------------
# Streaming forms
# --------------------------------------------------------------------------

ORACLE["stream_sessions"] = f"""WITH {scan_ctes(M_EVENTS)}
SELECT owner_id, thread_id, strftime(min(ts), {TS_FMT}) AS session_start,
       strftime(max(ts) + INTERVAL 6 HOUR, {TS_FMT}) AS session_end, count(*) AS n_msgs
FROM e GROUP BY owner_id, thread_id, conv_no"""

ORACLE["stream_turns"] = ORACLE["merge_turns"]

ORACLE["stream_resolve"] = ORACLE["phone_resolve"]

ORACLE["stream_reject_counts"] = f"""WITH {examples_ctes(M_EVENTS)}
SELECT strftime(date_trunc('day', ts), {TS_FMT}) AS day, reject_reason, count(*) AS n
FROM xr WHERE reject_reason IS NOT NULL GROUP BY ALL"""


# --------------------------------------------------------------------------
# Derived inputs for readers and joins
# --------------------------------------------------------------------------

VCARD_LINES = """vf AS (SELECT DISTINCT p FROM documents,
        unnest(regexp_extract_all(text, '\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}')) AS u(p)),
vc AS (SELECT p, CAST(right(regexp_replace(p, '[^0-9]', '', 'g'), 2) AS BIGINT) AS k,
              CAST(regexp_replace(p, '[^0-9]', '', 'g') AS BIGINT) AS card, c_name AS name
       FROM vf JOIN customer ON c_custkey = CAST(right(regexp_replace(p, '[^0-9]', '', 'g'), 2) AS BIGINT)),
vl0 AS (SELECT card, CASE WHEN k % 2 = 1
                     THEN ['BEGIN:VCARD', 'TEL;type=CELL:' || p, 'FN:' || name, 'END:VCARD']
                     ELSE ['BEGIN:VCARD', 'FN:' || name, 'TEL;type=CELL:' || p, 'item2.TEL:12', 'END:VCARD',
                           'BEGIN:VCARD', 'FN:' || name || ' (work)', 'TEL;type=CELL:' || p, 'END:VCARD'] END AS ls
        FROM vc),
vl AS (SELECT 'events' AS owner_id, card * 16 + j.i - 1 AS line_no, ls[j.i] AS v FROM vl0, range(1, len(ls) + 1) AS j(i)),
vb AS (SELECT *, coalesce(sum(CASE WHEN v = 'END:VCARD' THEN 1 ELSE 0 END) OVER (
                   PARTITION BY owner_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk
       FROM vl),
vn AS (SELECT *, last_value(CASE WHEN starts_with(v, 'FN:') THEN trim(substr(v, 4)) END IGNORE NULLS) OVER (
                   PARTITION BY owner_id, blk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name
       FROM vb),
vt AS (SELECT owner_id, line_no, name,
              regexp_replace(trim(list_last(string_split(v, ':'))), '[^0-9]', '', 'g') AS phone_norm
       FROM vn WHERE regexp_matches(v, '^(item[0-9]+\\.)?TEL') AND NOT starts_with(v, 'FN:')),
vcards AS (SELECT owner_id, phone_norm, name FROM (
             SELECT *, row_number() OVER (PARTITION BY owner_id, phone_norm ORDER BY line_no DESC) AS rn FROM vt
             WHERE coalesce(name, '') <> '' AND length(phone_norm) >= 10) WHERE rn = 1)"""

ORACLE["vcard_contacts"] = f"""WITH {VCARD_LINES}
SELECT owner_id, phone_norm, name FROM vcards"""

ORACLE["contact_corrections"] = f"""WITH {VCARD_LINES},
vnorm AS (SELECT owner_id, CASE WHEN length(phone_norm) = 11 AND starts_with(phone_norm, '1') THEN substr(phone_norm, 2) ELSE phone_norm END AS phone_norm, name FROM vcards),
fx AS (SELECT 'events' AS owner_id, '212555' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phone_norm, c_name AS name
       FROM customer WHERE c_custkey IN (SELECT DISTINCT user_id FROM events) AND c_custkey % 2 = 0
       UNION ALL SELECT owner_id, substr(phone_norm, 2, 10), name || ' (fixed)' FROM vcards),
modes(mode, pc, pf) AS (VALUES ('keep', 0, 1), ('overwrite', 1, 0)),
u AS (SELECT v.*, m.mode, m.pc AS p FROM vnorm v, modes m UNION ALL SELECT f.*, m.mode, m.pf FROM fx f, modes m)
SELECT owner_id, phone_norm, name, mode FROM (
  SELECT *, row_number() OVER (PARTITION BY mode, owner_id, phone_norm ORDER BY p) AS rn FROM u) WHERE rn = 1"""

ORACLE["metadata_entries"] = f"""WITH mt AS (
  SELECT c_mktsegment AS owner_id,
         string_agg(c_name || ': balance ' || printf('%.2f', c_acctbal) || ', nation ' || CAST(c_nationkey AS VARCHAR),
                    chr(10) || '---' || chr(10) ORDER BY c_name || ': balance ' || printf('%.2f', c_acctbal)
                    || ', nation ' || CAST(c_nationkey AS VARCHAR)) AS value
  FROM customer GROUP BY c_mktsegment),
me AS (SELECT owner_id, {_strip('e')} AS e FROM mt, unnest(string_split(value, '---')) AS u(e))
SELECT owner_id, {_strip("split_part(e, ':', 1)")} AS name, {_strip("substr(e, instr(e, ':') + 1)")} AS description
FROM me WHERE e <> '' AND contains(e, ':') AND {_strip("split_part(e, ':', 1)")} <> ''
  AND {_strip("substr(e, instr(e, ':') + 1)")} <> ''"""

ORACLE["metadata_strings"] = f"""WITH {turns_ctes(M_EVENTS)},
sp AS (SELECT DISTINCT owner_id, thread_id, speaker FROM t WHERE speaker <> 'Me'),
g AS (SELECT owner_id, thread_id, string_agg(speaker || ': sends ' || speaker || ' events', chr(10) ORDER BY speaker) AS l
      FROM sp GROUP BY ALL),
th AS (SELECT DISTINCT owner_id, thread_id FROM t)
SELECT th.owner_id, th.thread_id,
       CASE WHEN g.l IS NULL THEN '' ELSE {_q(_exm.METADATA_HEADER)} || chr(10) || g.l END AS metadata
FROM th LEFT JOIN g USING (owner_id, thread_id)"""

_TX = """tx0 AS (
  SELECT conv_id AS transcript_id,
         'Topic: conversation ' || CAST(conv_id AS VARCHAR) || '<|>Prompt: reply<|>'
         || string_agg('[2024-01-01 00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00] ' || role || ': ' || text,
                       '<|>' ORDER BY turn) || '<|>' AS text
  FROM conversations GROUP BY conv_id)"""

# Parts with their place, and the place of the first one with both brackets.
_PARTS = """pp AS (SELECT transcript_id, j.i - 1 AS pos, string_split(text, '<|>')[j.i] AS part
       FROM tx, range(1, len(string_split(text, '<|>')) + 1) AS j(i)),
pf AS (SELECT *, min(CASE WHEN contains(part, '[') AND contains(part, ']') THEN pos END) OVER (PARTITION BY transcript_id) AS f FROM pp)"""

ORACLE["transcript_split"] = f"""WITH {_TX},
tx AS (SELECT * FROM tx0 UNION ALL SELECT transcript_id + 1000000000, translate(text, '[]', '') FROM tx0
       UNION ALL SELECT transcript_id + 2000000000, replace(text, '[2024-01-01 00:00:00] ', ' ') FROM tx0),
{_PARTS}
SELECT transcript_id, CAST(pos AS INTEGER) AS pos, 'header' AS kind, {_strip("split_part(part, ':', 1)")} AS key,
       {_strip("substr(part, instr(part, ':') + 1)")} AS value, {_strip('part')} AS line
FROM pf WHERE (f IS NULL OR pos < f) AND contains(part, ':')
UNION ALL
SELECT transcript_id, CAST(pos AS INTEGER), 'message',
       {_strip("regexp_replace(replace(split_part(part, ': ', 1), 'assistant', 'Me'), '^[[:space:]]*[[][^]]*[]]', '')")},
       {_strip("substr(part, instr(part, ': ') + 2)")},
       replace(split_part(part, ': ', 1), 'assistant', 'Me') || ': ' || {_strip("substr(part, instr(part, ': ') + 2)")}
FROM pf WHERE (f IS NULL OR pos >= f) AND contains(part, ': ')"""

ORACLE["transcript_messages"] = f"""WITH {_TX}, tx AS (SELECT * FROM tx0),
{_PARTS},
h AS (SELECT transcript_id, string_agg({_strip('part')}, chr(10) ORDER BY pos) AS h FROM pf WHERE pos < f AND contains(part, ':') GROUP BY ALL),
c AS (SELECT transcript_id, string_agg(replace(split_part(part, ': ', 1), 'assistant', 'Me') || ': ' || {_strip("substr(part, instr(part, ': ') + 2)")},
             chr(10) ORDER BY pos) AS c FROM pf WHERE pos >= f AND contains(part, ': ') GROUP BY ALL)
SELECT transcript_id, 'Here is a conversation topic that you can begin conversation about with people. Make sure to respond to current conversation, '
       || 'and only use this as a guideline if there hasn''t been any conversation yets. [BEGIN TOPIC METADATA]' || chr(10) || h || chr(10) || '[END TOPIC METADATA].' AS system_message,
       'Current conversation:' || chr(10) || c || chr(10) || '[2024-02-01 00:00:00] Me: ' AS user_message
FROM h JOIN c USING (transcript_id)"""

ORACLE["export_files"] = f"""WITH {EM},
n AS (SELECT *, CAST(1 + coalesce(sum(4 + CAST(coalesce(is_reply, false) AS INTEGER)) OVER (PARTITION BY thread_id ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM em)
SELECT CASE WHEN CAST(thread_id AS BIGINT) % 3 = 0 THEN 'other owner' ELSE owner_id END AS owner_id, thread_id, line AS seq, strftime(ts, {TS_FMT}) AS ts,
       speaker, content, is_reply, CASE WHEN is_reply THEN 'This message responded to an earlier message.' END AS reply_info
FROM n WHERE NOT starts_with(content, 'Edited to')"""

ORACLE["messenger_files"] = f"""WITH mf AS (
  SELECT conv_id AS k, turn AS t, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
         'Friend ' || CAST(conv_id % 5 AS VARCHAR) AS friend FROM conversations)
SELECT CAST(k % 2 AS VARCHAR) AS owner_id, CAST(k AS VARCHAR) AS thread_id, pos AS seq,
       strftime(make_timestamp((1700000000 + k * 3600 + t * 60) * 1000000), {TS_FMT}) AS ts,
       CASE WHEN role = 'assistant' THEN 'Me' ELSE friend END AS speaker, text AS content,
       CASE WHEN t % 3 = 1 THEN '♥ by ' || friend || chr(10) || 'wow by Owner' END AS reactions
FROM mf WHERE k % 9 <> 0 AND k % 11 <> 0 AND t % 4 <> 3"""

ORACLE["discord_files"] = f"""WITH df AS (
  SELECT conv_id // 10 AS ch, make_timestamp((1700000000 + conv_id * 3600 + turn * 60) * 1000000) AS ts, turn AS t,
         CASE WHEN conv_id % 2 = 0 THEN 'Name of ' || role ELSE role END AS speaker, {_strip('text')} AS content FROM conversations)
SELECT 'o' AS owner_id, CAST(ch AS VARCHAR) AS thread_id, row_number() OVER (PARTITION BY ch ORDER BY ts) AS seq,
       strftime(ts, {TS_FMT}) AS ts, speaker, content FROM df WHERE t % 5 <> 4 AND t % 7 <> 6 AND content <> ''"""

ORACLE["vcard_files"] = ORACLE["vcard_contacts"]

ORACLE["contact_files"] = """SELECT 'o ' || right(phone, 1) AS owner_id, phone, name FROM (
  SELECT '+1212555' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phone, c_name AS name
  FROM customer WHERE c_custkey IN (SELECT DISTINCT user_id FROM events) AND c_custkey % 2 = 0)"""

ORACLE["metadata_files"] = ORACLE["metadata_entries"]

ORACLE["filter_reasons_notebook"] = f"""WITH {examples_ctes(M_CONV, min_ts=7, banned=('GamePigeon message:',))}
SELECT owner_id, thread_id, conv_no, turn_idx, strftime(ts, {TS_FMT}) AS ts, reject_reason FROM xr"""

ORACLE["memory_bank"] = f"""WITH RECURSIVE {BANK}
SELECT owner_id, mem_id, CAST(level AS INTEGER) AS level,
       CASE WHEN level = 1 THEN 'original' WHEN level = 3 THEN 'top'
            ELSE (SELECT c.kind FROM comb c WHERE c.owner_id = bank.owner_id
                  AND 2305843009213693952 + c.batch_no * 16777216 + c.rec = bank.mem_id) END AS kind,
       attribute
FROM bank"""

ORACLE["drill_through"] = f"""WITH RECURSIVE {LINKED},
dr AS (SELECT b.owner_id, b.mem_id, CAST(NULL AS INTEGER) AS ord, CAST(NULL AS BIGINT) AS source_mem_id, lnk.thread_id, lnk.conv_no
       FROM bank b JOIN lnk USING (owner_id, mem_id)
       UNION ALL
       SELECT sx.owner_id, sx.mem_id, CAST(sx.ord AS INTEGER), sx.source_mem_id, lnk.thread_id, lnk.conv_no
       FROM sx JOIN lnk ON lnk.owner_id = sx.owner_id AND lnk.mem_id = sx.source_mem_id)
SELECT dr.owner_id, dr.mem_id, ord, source_mem_id, dr.thread_id, dr.conv_no, t.turn_idx, t.speaker, t.content
FROM dr JOIN t USING (owner_id, thread_id, conv_no)"""

ORACLE["embedding_coverage"] = """WITH m AS (SELECT 'events' AS owner_id, vec_id AS mem_id FROM embeddings),
c AS (SELECT 'events' AS owner_id, vec_id AS mem_id FROM embeddings WHERE label <> 9),
j AS (SELECT coalesce(m.owner_id, c.owner_id) AS owner_id, m.mem_id IS NOT NULL AS hm, c.mem_id IS NOT NULL AS hc
      FROM m FULL JOIN c ON m.owner_id = c.owner_id AND m.mem_id = c.mem_id)
SELECT owner_id, count(*) FILTER (WHERE hm AND hc) AS embedded, count(*) FILTER (WHERE hm AND NOT hc) AS missing,
       count(*) FILTER (WHERE NOT hm) AS orphaned FROM j GROUP BY owner_id"""
