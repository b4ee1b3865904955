"""DuckDB SQL for the registered queries.

Written from the definitions, over token rows with windows and recursion, and
so independent of the Spark plans, which work inside sentence rows.
"""

from __future__ import annotations

K = "conv_id, turn, line_no"
WS = r"[ \t\n\x0B\f\r]+"


def _type(tag: str) -> str:
    kind = f"CASE WHEN contains({tag}, '-') THEN substr({tag}, strpos({tag}, '-') + 1) ELSE '' END"
    return f"CASE WHEN {kind} = '0' THEN '' ELSE {kind} END"


def _prefix(tag: str) -> str:
    return f"split_part({tag}, '-', 1)"


def _opens(p: str, c: str, pt: str, ct: str) -> str:
    return (
        f"(({p} || '>' || {c}) IN ('B>B','I>B','O>B','O>I','E>E','E>I','O>E')"
        f" OR ({c} NOT IN ('O','.') AND {pt} <> {ct}) OR {c} IN ('[',']'))"
    )


def _closes(p: str, c: str, pt: str, ct: str) -> str:
    return (
        f"(({p} || '>' || {c}) IN ('B>B','B>O','I>B','I>O','E>E','E>I','E>O')"
        f" OR ({p} NOT IN ('O','.') AND {pt} <> {ct}) OR {p} IN ('[',']'))"
    )


def _features(source: str) -> str:
    return f"""
  SELECT {K}, pos, 'TRIGRAM:' || t2 || ':' || t1 || ':' || tag AS feature FROM {source}
  UNION ALL
  SELECT {K}, pos, 'TAG:' || word || ':' || tag FROM {source} WHERE word IS NOT NULL
  UNION ALL
  SELECT {K}, pos, 'SUFF:' || right(word, j) || ':' || j || ':' || tag
  FROM {source}, (VALUES (1), (2)) AS s(j) WHERE word IS NOT NULL AND length(word) >= j"""


def _history(source: str, tag: str, stop_word: str = "NULL") -> str:
    return f"""
  SELECT {K}, pos, lag(tag, 2, '*') OVER w AS t2, lag(tag, 1, '*') OVER w AS t1, tag, word
  FROM (
    SELECT {K}, pos, word, {tag} AS tag FROM {source}
    UNION ALL
    SELECT {K}, max(pos) + 1, {stop_word}, 'STOP' FROM {source} GROUP BY {K}
  ) WINDOW w AS (PARTITION BY {K} ORDER BY pos)"""


def _token_rows(table: str, keys: str, name: str) -> str:
    return f"""
{name}_lines AS (
  SELECT {keys}, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no
  FROM {table}
),
{name}_lists AS (
  SELECT {keys}, line_no, list_filter(string_split_regex(line, '{WS}'), lambda w: w <> '') AS words
  FROM {name}_lines
),
{name}_words AS (
  SELECT {keys}, line_no, unnest(words) AS word, generate_subscripts(words, 1)::INTEGER AS pos
  FROM {name}_lists
),
{name}_gold AS (
  SELECT *, CASE WHEN pos > 1 AND regexp_matches(word, '^[A-Z]')
    THEN (CASE WHEN substr(md5(word), 1, 1) < '4' THEN 'B-' ELSE 'I-' END)
         || ['LOC','MISC','ORG','PER'][(strpos('0123456789abcdef', substr(md5(word), 2, 1)) - 1) % 4 + 1]
    ELSE 'O' END AS tag,
    substr(md5(word || ':' || pos), 1, 1) AS h
  FROM {name}_words
),
{name}_tokens AS MATERIALIZED (
  SELECT {keys}, line_no, pos, word, tag, CASE
    WHEN tag <> 'O' AND h < '3' THEN 'O'
    WHEN h = '3' THEN 'I-PER'
    WHEN tag <> 'O' AND h = '4' THEN (CASE WHEN tag[1] = 'B' THEN 'I' ELSE 'B' END) || substr(tag, 2)
    ELSE tag END AS guess
  FROM {name}_gold
)"""


def _events(tokens: str, keys: str, name: str) -> str:
    def flags(side: str, p: str, c: str) -> str:
        around = (p, c, f"{p}_type", f"{c}_type")
        return f"{_opens(*around)} AS open_{side}, {_closes(*around)} AS end_{side}"

    return f"""
{name}_split AS (
  SELECT {keys}, pos, TRUE AS token, {_prefix('tag')} AS g, {_type('tag')} AS g_type,
         {_prefix('guess')} AS h, {_type('guess')} AS h_type
  FROM {tokens}
  UNION ALL
  SELECT {keys}, max(pos) + 1, FALSE, 'O', '', 'O', '' FROM {tokens} GROUP BY {keys}
),
{name}_before AS (
  SELECT *, lag(g, 1, 'O') OVER w AS pg, lag(g_type, 1, '') OVER w AS pg_type,
         lag(h, 1, 'O') OVER w AS ph, lag(h_type, 1, '') OVER w AS ph_type
  FROM {name}_split WINDOW w AS (PARTITION BY {keys} ORDER BY pos)
),
{name}_flags AS (
  SELECT *, {flags('gold', 'pg', 'g')}, {flags('guess', 'ph', 'h')} FROM {name}_before
),
{name}_states AS (
  SELECT *, end_gold AND end_guess AND pg_type = ph_type AS close,
         (end_gold AND end_guess AND pg_type = ph_type) OR end_gold <> end_guess OR g_type <> h_type AS reset,
         open_gold AND open_guess AND g_type = h_type AS start_ok
  FROM {name}_flags
),
{name} AS MATERIALIZED (
  SELECT *, close AND last_start IS NOT NULL AND last_start >= coalesce(last_reset, 0) AS correct
  FROM (
    SELECT *, max(CASE WHEN start_ok THEN pos END) OVER w AS last_start,
           max(CASE WHEN reset THEN pos END) OVER w AS last_reset
    FROM {name}_states
    WINDOW w AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  )
)"""


def _counts(events: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT type, sum(gold)::BIGINT AS found_gold, sum(guess)::BIGINT AS found_guess,
         sum(correct)::BIGINT AS correct_chunks
  FROM (
    SELECT g_type AS type, 1 AS gold, 0 AS guess, 0 AS correct FROM {events} WHERE open_gold
    UNION ALL SELECT h_type, 0, 1, 0 FROM {events} WHERE open_guess
    UNION ALL SELECT pg_type, 0, 0, 1 FROM {events} WHERE correct
  ) GROUP BY type
),
{name}_total AS (
  SELECT count(*) FILTER (token) AS tokens,
         count(*) FILTER (token AND g = h AND g_type = h_type) AS correct_tags,
         count(*) FILTER (open_gold) AS found_gold, count(*) FILTER (open_guess) AS found_guess,
         count(*) FILTER (correct) AS correct_chunks
  FROM {events}
)"""


P = "(CASE WHEN found_guess > 0 THEN 100.0::DOUBLE * correct_chunks / found_guess ELSE 0 END)"
R = "(CASE WHEN found_gold > 0 THEN 100.0::DOUBLE * correct_chunks / found_gold ELSE 0 END)"
F1 = f"(CASE WHEN {P} + {R} > 0 THEN 2 * {P} * {R} / ({P} + {R}) ELSE 0 END)"
A = "(CASE WHEN tokens > 0 THEN 100.0::DOUBLE * correct_tags / tokens ELSE 0 END)"
SCORES = f"round({P}, 6) AS precision, round({R}, 6) AS recall, round({F1}, 6) AS f1"
TOTAL = f"tokens, correct_tags, found_gold, found_guess, correct_chunks, round({A}, 6) AS accuracy, {SCORES}"

TOKENS = _token_rows("conversations", "conv_id, turn", "conv") + f""",
tokens AS (SELECT {K}, pos, word, tag, guess FROM conv_tokens),
sentences AS (SELECT {K}, max(pos) AS n FROM tokens GROUP BY {K}),
ranks AS (SELECT {K}, row_number() OVER (ORDER BY {K}) AS sent_id FROM sentences)"""
HISTORY = TOKENS + f""",
history AS MATERIALIZED ({_history('tokens', 'tag')}),
features AS MATERIALIZED ({_features('history')})"""
MODEL = HISTORY + """,
model AS MATERIALIZED (SELECT feature, (count(*) % 7 - 3)::DOUBLE AS weight FROM features GROUP BY feature)"""
EVENTS = TOKENS + "," + _events("tokens", K, "events") + "," + _counts("events", "counts")

TAGS = """,
tags AS MATERIALIZED (
  SELECT DISTINCT t AS tag FROM (
    SELECT unnest(string_split(feature, ':')[2:]) AS t FROM model WHERE feature LIKE 'TRIGRAM:%'
  ) WHERE t NOT IN ('*', 'STOP')
),
moves AS MATERIALIZED (
  SELECT t2, t1, tag, coalesce(weight, 0) AS score
  FROM (SELECT tag AS t2 FROM tags UNION ALL SELECT '*') a, (SELECT tag AS t1 FROM tags UNION ALL SELECT '*') b,
       (SELECT tag FROM tags UNION ALL SELECT 'STOP') c
  LEFT JOIN model ON feature = 'TRIGRAM:' || t2 || ':' || t1 || ':' || tag
)"""


def _emissions(suffixes: bool, model: str = MODEL) -> str:
    """Word scores under the table ``model``, always summed in the same order."""
    extra = "+ coalesce(s1.weight, 0) + coalesce(s2.weight, 0)" if suffixes else ""
    return model + TAGS + f""",
emissions AS MATERIALIZED (
  SELECT word, tag, coalesce(w.weight, 0) {extra} AS score
  FROM (
    SELECT word, tag, 'TAG:' || word || ':' || tag AS word_feature, 'SUFF:' || right(word, 1) || ':1:' || tag AS last_one,
           CASE WHEN length(word) >= 2 THEN 'SUFF:' || right(word, 2) || ':2:' || tag END AS last_two
    FROM (SELECT DISTINCT word FROM tokens), tags
  )
  LEFT JOIN model w ON w.feature = word_feature
  LEFT JOIN model s1 ON s1.feature = last_one
  LEFT JOIN model s2 ON s2.feature = last_two
)"""


def _viterbi(suffixes: bool, model: str = MODEL) -> str:
    """Recursion over positions. Paths are strings of one character per tag; ties go to the larger tag."""
    return _emissions(suffixes, model) + f""",
coded AS (SELECT tag, chr((64 + row_number() OVER (ORDER BY tag))::INTEGER) AS code FROM tags),
gains AS MATERIALIZED (
  SELECT {K}, pos, e.tag, e.score, code
  FROM tokens t JOIN emissions e ON e.word = t.word JOIN coded c ON c.tag = e.tag
),
paths AS (
  SELECT {K}, n, 1 AS pos, '*' AS u, g.tag AS s, m.score + g.score AS score, code AS path
  FROM sentences JOIN gains g USING ({K}) JOIN moves m ON m.t2 = '*' AND m.t1 = '*' AND m.tag = g.tag
  WHERE g.pos = 1
  UNION ALL
  SELECT b.conv_id, b.turn, b.line_no, b.n, b.pos + 1, b.u, b.s, b.best.score + g.score, b.best.path || g.code
  FROM (
    SELECT p.conv_id, p.turn, p.line_no, p.n, p.pos, p.s AS u, m.tag AS s,
           max({{'score': p.score + m.score, 't': p.u, 'path': p.path}}) AS best
    FROM paths p JOIN moves m ON m.t2 = p.u AND m.t1 = p.s AND m.tag <> 'STOP'
    WHERE p.pos < p.n GROUP BY ALL
  ) b JOIN gains g ON g.conv_id = b.conv_id AND g.turn = b.turn AND g.line_no = b.line_no
      AND g.pos = b.pos + 1 AND g.tag = b.s
),
best AS MATERIALIZED (
  SELECT {K}, max({{'score': p.score + m.score, 'u': u, 's': s, 'path': path}}) AS b
  FROM paths p JOIN moves m ON m.t2 = p.u AND m.t1 = p.s AND m.tag = 'STOP'
  WHERE pos = n GROUP BY {K}
),
decoded AS (
  SELECT {K}, pos, word, c.tag FROM tokens t JOIN best USING ({K})
  JOIN coded c ON c.code = substr(b.path, pos, 1)
)"""


def _signed(source: str, gold: str, guess: str, name: str = "signed") -> str:
    return f"""
{name}_gold AS ({_history(source, gold, "'STOP'")}),
{name}_guess AS ({_history(source, guess, "'STOP'")}),
{name} AS (
  SELECT {K}, feature, 1 AS sign FROM ({_features(f'{name}_gold')})
  UNION ALL
  SELECT {K}, feature, -1 FROM ({_features(f'{name}_guess')})
)"""


WRONG = MODEL + f""",
wrong AS (SELECT * FROM tokens SEMI JOIN (SELECT DISTINCT {K} FROM tokens WHERE tag <> guess) USING ({K})),
{_signed('wrong', 'tag', 'guess')},
delta AS (SELECT feature, sum(sign)::DOUBLE AS weight FROM signed GROUP BY feature)"""

# Training of one-sentence shards. From zero weights every token is guessed as the largest tag.
FIRST_ROUND = TOKENS + f""",
wrong AS (SELECT * FROM tokens SEMI JOIN (
  SELECT DISTINCT {K} FROM tokens WHERE tag <> (SELECT max(tag) FROM tokens)) USING ({K})),
{_signed('wrong', 'tag', '(SELECT max(tag) FROM tokens)')},
deltas AS (SELECT {K}, feature, sum(sign) AS weight FROM signed GROUP BY {K}, feature),
model AS MATERIALIZED (SELECT feature, sum(weight)::DOUBLE / count(*) AS weight FROM deltas GROUP BY feature)"""
SECOND_ROUND = _viterbi(True, FIRST_ROUND) + f""",
again AS (SELECT {K}, pos, word, t.tag, d.tag AS guess FROM tokens t JOIN decoded d USING ({K}, pos, word)),
still_wrong AS (SELECT * FROM again SEMI JOIN (SELECT DISTINCT {K} FROM again WHERE tag <> guess) USING ({K})),
{_signed('still_wrong', 'tag', 'guess', 'second')},
second_deltas AS (SELECT {K}, feature, sum(sign) AS weight FROM second GROUP BY {K}, feature),
updates AS (SELECT feature, sum(weight)::DOUBLE AS delta, count(*) AS made FROM second_deltas GROUP BY feature)"""

SHARDS = HISTORY + f""",
shards AS (
  SELECT {K}, ((8 * sent_id - 1) // (SELECT count(*) FROM ranks))::BIGINT AS shard FROM ranks
),
shard_weights AS (
  SELECT shard, feature, (count(*) % 7 - 3)::DOUBLE AS weight
  FROM features JOIN shards USING ({K}) GROUP BY shard, feature
)"""


ITEMS = _token_rows("benchmark", "item_id", "item")


def _training(shards: int, epochs: int, rounds: int) -> str:
    """Online training by recursion: a step learns one sentence of one shard or mixes the shards of a round.

    The recursion's table is keyed: ``w/feature`` holds the mixed weights, ``round/shard/feature`` the updates of a
    shard, ``#`` the number of the next step. The guess of a sentence is a fold over its words: for all pairs of
    tags the best score and path; ties go to the larger tag. Tags are numbered from 1, the padding is 0.
    """
    place = "(b * (t + 1) + k // t) * (t + 1) + k % t + 1"
    cell = "STRUCT(s DOUBLE, b BIGINT, path VARCHAR)[]"
    weight = "coalesce(w.weight, 0) + coalesce(d.weight, 0)"

    def held(feature: str) -> str:
        return (
            f"LEFT JOIN recurring.training w ON w.feature = 'w/' || {feature} "
            f"LEFT JOIN recurring.training d ON d.feature = owner || {feature}"
        )

    return ITEMS + f""",
names AS MATERIALIZED (SELECT tag, row_number() OVER (ORDER BY tag) AS id FROM (SELECT DISTINCT tag FROM item_tokens)),
size AS MATERIALIZED (SELECT count(*) AS t, list(tag ORDER BY id) AS tag_names FROM names),
corpus AS MATERIALIZED (
  SELECT i, ({shards} * i - 1) // count(*) OVER () AS shard, words, gold FROM (
    SELECT row_number() OVER (ORDER BY item_id, line_no) AS i, list(word ORDER BY pos) AS words,
           string_agg(chr(64 + id::INTEGER), '' ORDER BY pos) AS gold
    FROM item_tokens JOIN names USING (tag) GROUP BY item_id, line_no
  )
),
schedule AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY r, shard, e, i) - 1 AS step, r, r || '/' || shard || '/' AS owner, words, gold
  FROM (
    SELECT r, shard, e, i, words, gold FROM corpus, range(1, {rounds} + 1) a(r), range({epochs}) b(e)
    UNION ALL SELECT r, {shards}, 0, 0, NULL, NULL FROM range(1, {rounds} + 1) a(r)
  )
),
ends AS MATERIALIZED (SELECT tag, id FROM names UNION ALL SELECT '*', 0 UNION ALL SELECT 'STOP', t + 1 FROM size),
grid AS MATERIALIZED (
  SELECT 'TRIGRAM:' || a.tag || ':' || b.tag || ':' || c.tag AS feature, a.id AS t2, b.id AS t1, c.id AS t
  FROM ends a, ends b, ends c WHERE a.tag <> 'STOP' AND b.tag <> 'STOP' AND c.tag <> '*'
),
training(feature, weight) USING KEY (feature) AS (
  SELECT '#', 0::DOUBLE
  UNION
  (WITH today AS (SELECT s.* FROM training JOIN schedule s ON feature = '#' AND step = weight::BIGINT),
  now AS (SELECT * FROM today WHERE words IS NOT NULL),
  contexts AS (
    SELECT owner, word, unnest(list_filter(['TAG:' || word, CASE WHEN length(word) >= 1 THEN 'SUFF:' || right(word, 1) || ':1' END,
      CASE WHEN length(word) >= 2 THEN 'SUFF:' || right(word, 2) || ':2' END], lambda c: c IS NOT NULL)) AS context
    FROM (SELECT DISTINCT owner, unnest(words) AS word FROM now)
  ),
  gains AS (
    SELECT word, list(gain ORDER BY id) AS gain FROM (
      SELECT word, id, sum({weight}) AS gain
      FROM (SELECT owner, word, id, context || ':' || tag AS name FROM contexts CROSS JOIN names) {held('name')}
      GROUP BY word, id
    ) GROUP BY word
  ),
  moves AS (
    SELECT list({weight} ORDER BY t2, t1, t) AS m
    FROM (SELECT g.feature AS name, t2, t1, t, owner FROM grid g CROSS JOIN now) {held('name')}
  ),
  steps AS (
    SELECT list({{'gain': gain, 'best': NULL::{cell}}} ORDER BY pos) AS gains
    FROM (SELECT unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM now) JOIN gains USING (word)
  ),
  decoded AS (
    SELECT owner, words, gold, t, m, list_reduce(
      list_prepend({{'gain': NULL::DOUBLE[], 'best': NULL::{cell}}}, gains),
      lambda a, e: {{'gain': NULL::DOUBLE[], 'best': list_transform(range(0, (t + 1) * t), lambda k: CASE
        WHEN a.best IS NULL THEN
          {{'s': CASE WHEN k < t THEN m[k + 1] + e.gain[k + 1] ELSE '-infinity'::DOUBLE END, 'b': 0, 'path': chr((65 + k % t)::INTEGER)}}
        WHEN k < t THEN {{'s': '-infinity'::DOUBLE, 'b': 0, 'path': ''}}
        ELSE list_transform([list_max(list_transform(range(0, t + 1), lambda b:
            {{'s': a.best[b * t + k // t].s + m[{place}], 'b': b}}))],
          lambda x: {{'s': x.s + e.gain[k % t + 1], 'b': x.b, 'path': a.best[x.b * t + k // t].path || chr((65 + k % t)::INTEGER)}})[1] END)}}
    ).best AS best
    FROM now, size, moves, steps
  ),
  guessed AS (
    SELECT owner, words, gold, list_max(list_transform(range(0, (t + 1) * t), lambda k: {{
      's': best[k + 1].s + m[(k // t * (t + 1) + k % t + 1) * (t + 1) + t + 1], 'u': k // t, 'v': k % t, 'path': best[k + 1].path
    }})).path AS guess FROM decoded
  ),
  sides AS (
    SELECT owner, words, unnest([{{'path': gold, 'sign': 1}}, {{'path': guess, 'sign': -1}}], recursive := true)
    FROM guessed WHERE guess <> gold
  ),
  padded AS (
    SELECT owner, sign, list_append(words, 'STOP') AS words, list_concat(['*', '*'], list_append(
      list_transform(string_split(path, ''), lambda c: tag_names[ascii(c) - 64]), 'STOP')) AS tags
    FROM sides, size
  ),
  histories AS (
    SELECT owner, sign, unnest(list_transform(range(1, len(words) + 1), lambda p:
      {{'t2': tags[p], 't1': tags[p + 1], 'tag': tags[p + 2], 'word': words[p]}}), recursive := true) FROM padded
  ),
  updates AS (
    SELECT owner, sign, 'TRIGRAM:' || t2 || ':' || t1 || ':' || tag AS name FROM histories
    UNION ALL SELECT owner, sign, 'TAG:' || word || ':' || tag FROM histories
    UNION ALL SELECT owner, sign, 'SUFF:' || right(word, j) || ':' || j || ':' || tag
    FROM histories, (VALUES (1), (2)) AS s(j) WHERE length(word) >= j
  ),
  learnt AS (SELECT owner || name AS name, sum(sign)::DOUBLE AS delta FROM updates GROUP BY owner, name),
  made AS (
    SELECT regexp_replace(d.feature, '^[0-9]+/[0-9]+/', '') AS name, sum(d.weight) AS delta, count(*) AS shards
    FROM today JOIN recurring.training d ON words IS NULL AND starts_with(d.feature, r || '/') GROUP BY name
  )
  SELECT '#', step + 1.0 FROM today
  UNION ALL
  SELECT name, coalesce(d.weight, 0) + delta FROM learnt LEFT JOIN recurring.training d ON d.feature = name
  UNION ALL
  SELECT 'w/' || name, coalesce(w.weight, 0) + delta / CASE WHEN w.feature IS NULL THEN shards ELSE {shards} END
  FROM made LEFT JOIN recurring.training w ON w.feature = 'w/' || name
  )
)"""


def _text_lines(latex: bool) -> str:
    rates = f"printf('precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f', {P}, {R}, {F1})"
    cells = rf"printf('&  %6.2f\%% & %6.2f\%% & %6.2f \\', {P}, {R}, {F1})"
    if latex:
        return rf"""
  SELECT row_number() OVER (ORDER BY rank, type)::INTEGER AS line_no,
         line || CASE WHEN lead(rank) OVER (ORDER BY rank, type) = 3 THEN '\hline' ELSE '' END AS line
  FROM (
    SELECT 0 AS rank, '' AS type, '        & Precision &  Recall  & F$_{{\beta=1}} \\\hline' AS line
    UNION ALL SELECT 2, type, printf('%-7s ', type) || {cells} FROM counts
    UNION ALL SELECT 3, '', 'Overall ' || {cells} || '\hline' FROM counts_total
  )"""
    return f"""
  SELECT row_number() OVER (ORDER BY rank, type)::INTEGER AS line_no, line
  FROM (
    SELECT 0 AS rank, '' AS type, printf('processed %d tokens with %d phrases; found: %d phrases; correct: %d.',
           tokens, found_gold, found_guess, correct_chunks) AS line FROM counts_total
    UNION ALL SELECT 1, '', printf('accuracy: %6.2f%%; ', {A}) || {rates} FROM counts_total
    UNION ALL SELECT 2, type, printf('%17s: ', type) || {rates} || printf('  %d', found_guess) FROM counts
  )"""


def _with(parts: str, select: str) -> str:
    return f"WITH RECURSIVE {parts}\n{select}"


def _lines(expression: str, order: str = "pos") -> str:
    return f"SELECT {K}, string_agg({expression}, chr(10) ORDER BY {order}) || chr(10) AS lines FROM tokens GROUP BY {K}"


TRAINED = "SELECT feature[3:] AS feature, round(weight, 6) AS weight FROM training WHERE starts_with(feature, 'w/')"
NUMBERED = f"FROM tokens JOIN ranks USING ({K})"
BARE = "CASE WHEN {0} = 'O' THEN 'O' ELSE 'B-' || " + "split_part({0}, '-', 2) END"

SQL: dict[str, str] = {
    "tokenize_sentences": _with(TOKENS, f"SELECT {K}, pos, word FROM tokens"),
    "tokenize_documents": _with(
        _token_rows("documents", "doc_id", "doc"),
        "SELECT doc_id, count(*) AS tokens, max(line_no) AS lines, max(pos) AS longest FROM doc_words GROUP BY doc_id",
    ),
    "read_conll": _with(TOKENS, f"SELECT sent_id, pos, word, tag {NUMBERED}"),
    "read_unlabeled": _with(TOKENS, f"SELECT sent_id, pos, word {NUMBERED}"),
    "read_weights": _with(MODEL, "SELECT feature, weight FROM model"),
    "weights_to_text": _with(MODEL, "SELECT feature || ' ' || printf('%.1f', weight) AS line FROM model"),
    "decode_output_lines": _with(TOKENS, _lines("word || ' ' || tag")),
    "eval_parse_lines": _with(
        TOKENS, f"SELECT {K}, pos, word AS first_item, tag AS correct_tag, guess AS guessed_tag FROM tokens"
    ),
    "read_eval": _with(TOKENS, f"SELECT sent_id, pos, word, tag, guess {NUMBERED}"),
    "make_eval_lines": _with(TOKENS, _lines("word || ' ' || tag || ' ' || guess")),
    "unlabeled_projection": _with(TOKENS, f"SELECT {K}, pos, word FROM tokens"),
    "features_trigram": _with(HISTORY, f"SELECT {K}, pos, feature FROM features WHERE feature LIKE 'TRIGRAM:%'"),
    "features_tag": _with(HISTORY, f"SELECT {K}, pos, feature FROM features WHERE feature LIKE 'TAG:%'"),
    "features_suffix": _with(HISTORY, f"SELECT {K}, pos, feature FROM features WHERE feature LIKE 'SUFF:%'"),
    "feature_vector": _with(HISTORY, f"SELECT {K}, pos, feature FROM features"),
    "parse_feature": _with(
        HISTORY,
        """SELECT DISTINCT 'TRIGRAM:' || t2 || ':' || t1 || ':' || tag AS feature, 'TRIGRAM' AS family,
             t2 || ':' || t1 AS context, NULL::INTEGER AS j, tag FROM history
           UNION SELECT 'TAG:' || word || ':' || tag, 'TAG', word, NULL, tag FROM history WHERE word IS NOT NULL
           UNION SELECT 'SUFF:' || right(word, j) || ':' || j || ':' || tag, 'SUFF', right(word, j), j, tag
             FROM history, (VALUES (1), (2)) AS s(j) WHERE word IS NOT NULL AND length(word) >= j""",
    ),
    "known_feature_filter": _with(
        MODEL, f"SELECT {K}, pos, feature FROM features WHERE feature IN (SELECT feature FROM model WHERE weight > 0)"
    ),
    "mistakes": _with(TOKENS, f"SELECT DISTINCT {K} FROM tokens WHERE tag <> guess"),
    "eval_tag_split": _with(
        TOKENS,
        f"SELECT {K}, pos, {_prefix('tag')} AS prefix, {_type('tag')} AS type, "
        f"{_prefix('guess')} AS guess_prefix, {_type('guess')} AS guess_type FROM tokens",
    ),
    "eval_raw_mode": _with(
        TOKENS, f"SELECT {K}, pos, {BARE.format('tag')} AS tag, {BARE.format('guess')} AS guess FROM tokens"
    ),
    "pad_sequence": _with(TOKENS, _history("tokens", "tag", "'STOP'")),
    "weight_lookup": _with(
        MODEL,
        f"SELECT {K}, pos, feature, coalesce(weight, 0) AS weight FROM features "
        "LEFT JOIN (SELECT * FROM model WHERE weight > 0) USING (feature)",
    ),
    "tag_lattice": _with(
        TOKENS, f"SELECT {K}, pos, word, candidate FROM tokens, (SELECT DISTINCT tag AS candidate FROM tokens)"
    ),
    "join_gold_pred": _with(TOKENS, f"SELECT {K}, pos, word, tag, guess FROM tokens"),
    "mean_by_key": "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "combine_mean": "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "combine_top_values": """SELECT event_type, v[1] AS "first", v[2] AS "second", v[3] AS third
        FROM (SELECT event_type, list_reverse_sort(list_distinct(list(value))) AS v FROM events GROUP BY event_type)""",
    "mix_weights": _with(SHARDS, "SELECT feature, round(avg(weight), 6) AS weight FROM shard_weights GROUP BY feature"),
    "mix_weights_uniform": _with(
        SHARDS, "SELECT feature, round(sum(weight) / 8, 6) AS weight FROM shard_weights GROUP BY feature"
    ),
    "inner_product": _with(
        MODEL, f"SELECT {K}, sum(weight) AS score FROM features JOIN model USING (feature) GROUP BY {K}"
    ),
    "feature_counts": _with(HISTORY, f"SELECT {K}, feature, count(*) AS n FROM features GROUP BY {K}, feature"),
    "tag_set": _with(TOKENS, "SELECT DISTINCT tag FROM tokens"),
    "tags_from_weights": _with(MODEL + TAGS, "SELECT tag FROM tags"),
    "collect_sentences": _with(
        TOKENS,
        f"SELECT {K}, string_agg(word, ' ' ORDER BY pos) AS words, string_agg(tag, ' ' ORDER BY pos) AS tags, "
        f"string_agg(guess, ' ' ORDER BY pos) AS guesses FROM tokens GROUP BY {K}",
    ),
    "sentence_stats": _with(
        TOKENS,
        "SELECT count(*) AS sentences, sum(n)::BIGINT AS tokens, count(*) FILTER (wrong) AS mistakes "
        f"FROM (SELECT count(*) AS n, bool_or(tag <> guess) AS wrong FROM tokens GROUP BY {K})",
    ),
    "history_trigrams": _with(HISTORY, f"SELECT {K}, pos, t2, t1, tag FROM history"),
    "eval_prev_tags": _with(EVENTS, f"SELECT {K}, pos, pg, pg_type, ph, ph_type FROM events WHERE token"),
    "eval_correct_scan": _with(
        EVENTS, f"SELECT {K}, pos, close, reset, start_ok, correct FROM events WHERE reset OR start_ok"
    ),
    "emission_scores": _with(_emissions(True), "SELECT word, tag, score FROM emissions"),
    "transition_scores": _with(MODEL + TAGS, "SELECT t2, t1, tag, score FROM moves"),
    "viterbi_decode": _with(_viterbi(False), f"SELECT {K}, pos, word, tag FROM decoded"),
    "viterbi_score": _with(_viterbi(True), f"SELECT {K}, b.score AS score FROM best"),
    "viterbi_decode_joined": _with(_viterbi(False), f"SELECT {K}, pos, word, tag FROM decoded"),
    "perceptron_delta": _with(WRONG, "SELECT feature, weight FROM delta"),
    "apply_update": _with(
        WRONG,
        "SELECT feature, sum(weight) AS weight FROM (SELECT * FROM model UNION ALL SELECT * FROM delta) GROUP BY feature",
    ),
    "reset_weights": _with(MODEL, "SELECT feature, 0::DOUBLE AS weight FROM model"),
    "train_pm_singleton": _with(FIRST_ROUND, "SELECT feature, round(weight, 6) AS weight FROM model"),
    "train_iterative_singleton": _with(
        SECOND_ROUND,
        """SELECT feature, round(CASE WHEN m.feature IS NULL THEN delta / made
             ELSE m.weight + coalesce(delta, 0) / (SELECT count(*) FROM sentences) END, 6) AS weight
           FROM model m FULL JOIN updates u USING (feature)""",
    ),
    "train_items_one_shard": _with(_training(1, 5, 1), TRAINED),
    "train_items_mixing": _with(_training(2, 5, 1), TRAINED),
    "train_items_iterative": _with(_training(2, 1, 3), TRAINED),
    "shard_assign": _with(SHARDS, f"SELECT {K}, shard FROM shards"),
    "shard_assign_tokens": _with(
        TOKENS,
        f"""SELECT {K}, (8 * coalesce(sum(n) OVER (ORDER BY {K} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              // (SELECT count(*) FROM tokens))::BIGINT AS shard FROM sentences""",
    ),
    "sql_chunk_events": _with(
        EVENTS, f"SELECT {K}, pos, g AS prefix, g_type AS type, open_gold, open_guess, end_gold, end_guess FROM events"
    ),
    "sql_features": _with(
        MODEL,
        """, cells AS (
             SELECT DISTINCT 'TRIGRAM:' || t2 || ':' || t1 || ':' || tag AS feature, 'TRIGRAM' AS family,
               t2 || ':' || t1 AS context, NULL::INTEGER AS j, tag FROM history
             UNION SELECT 'TAG:' || word || ':' || tag, 'TAG', word, NULL, tag FROM history WHERE word IS NOT NULL
             UNION SELECT 'SUFF:' || right(word, j) || ':' || j || ':' || tag, 'SUFF', right(word, j), j, tag
               FROM history, (VALUES (1), (2)) AS s(j) WHERE word IS NOT NULL AND length(word) >= j)
           SELECT family, tag, j, count(*) AS features, count(DISTINCT context) AS contexts, sum(weight) AS weight,
                  max(context) AS last_context
           FROM cells JOIN model USING (feature) GROUP BY family, tag, j""",
    ),
    "sql_suffixes": _with(
        _token_rows("documents", "doc_id", "doc"),
        "SELECT right(word, 2) AS suffix, count(*) AS n, count(DISTINCT word) AS words FROM doc_words "
        "WHERE length(word) >= 2 GROUP BY right(word, 2)",
    ),
    "eval_chunk_starts": _with(EVENTS, f"SELECT {K}, pos, open_gold, open_guess FROM events WHERE token"),
    "eval_chunk_ends": _with(EVENTS, f"SELECT {K}, pos, end_gold, end_guess FROM events"),
    "eval_chunks_gold": _with(EVENTS, "SELECT type, found_gold FROM counts WHERE found_gold > 0"),
    "eval_chunks_guess": _with(EVENTS, "SELECT type, found_guess FROM counts WHERE found_guess > 0"),
    "eval_chunks_correct": _with(EVENTS, "SELECT type, correct_chunks FROM counts WHERE correct_chunks > 0"),
    "eval_token_accuracy": _with(EVENTS, "SELECT tokens, correct_tags FROM counts_total"),
    "chunk_spans": _with(
        EVENTS,
        f"""SELECT {K}, pos AS start, next_end - 1 AS "end", g_type AS type FROM (
              SELECT *, min(CASE WHEN end_gold THEN pos END) OVER (
                PARTITION BY {K} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_end
              FROM events
            ) WHERE open_gold""",
    ),
    "prf": _with(
        EVENTS,
        f"""SELECT turn, tokens, correct_tags, found_gold, found_guess, correct_chunks, {SCORES} FROM (
              SELECT turn, count(*) FILTER (token) AS tokens,
                     count(*) FILTER (token AND g = h AND g_type = h_type) AS correct_tags,
                     count(*) FILTER (open_gold) AS found_gold, count(*) FILTER (open_guess) AS found_guess,
                     count(*) FILTER (correct) AS correct_chunks
              FROM events GROUP BY turn)""",
    ),
    "eval_overall": _with(EVENTS, f"SELECT {TOTAL} FROM counts_total"),
    "eval_by_type": _with(EVENTS, f"SELECT type, found_gold, found_guess, correct_chunks, {SCORES} FROM counts"),
    "eval_sorted_types": _with(EVENTS, "SELECT type FROM counts ORDER BY type"),
    "eval_report_text": _with(EVENTS, _text_lines(latex=False)),
    "eval_report_latex": _with(EVENTS, _text_lines(latex=True)),
    "eval_documents": _with(
        _token_rows("documents", "doc_id", "doc")
        + ","
        + _events("doc_tokens", "doc_id, line_no", "doc_events")
        + ","
        + _counts("doc_events", "doc_counts"),
        f"SELECT {TOTAL} FROM doc_counts_total",
    ),
    "tag_and_score": _with(
        _viterbi(True)
        + f""",
scored AS (SELECT {K}, pos, t.tag, d.tag AS guess FROM tokens t JOIN decoded d USING ({K}, pos)),
{_events('scored', K, 'scored_events')},
{_counts('scored_events', 'scored_counts')}""",
        f"SELECT type, found_gold, found_guess, correct_chunks, {SCORES} FROM scored_counts",
    ),
    "stream_decode": _with(_viterbi(False), f"SELECT {K}, pos, word, tag FROM decoded"),
    "stream_decode_joined": _with(_viterbi(False), f"SELECT {K}, pos, word, tag FROM decoded"),
    "stream_lines_decode": _with(
        _viterbi(False),
        "SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS sentence, pos, word, tag "
        "FROM decoded",
    ),
    "stream_lines_counts": _with(EVENTS, f"SELECT type, found_gold, found_guess, correct_chunks, {SCORES} FROM counts"),
    "stream_eval_counts": _with(EVENTS, "SELECT type, found_gold, found_guess, correct_chunks FROM counts"),
}
