"""Log and library tables derived from the given tables.

Each fixture is one SELECT that Spark and DuckDB both run. `{name}` stands for a given table
or another fixture. Secrets are put together from pieces, so no text that looks like one is
stored here.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SCOPE_RULES = (("source/private", "private"), ("", "work"), ("source/repos", "work"), ("source/infra", "both"))
# No store for `both`: its sessions go to the unclassified store.
STORES = {"private": "store_private", "work": "store_work"}

_SESSION = "concat('s', lpad(CAST({0} AS STRING), 8, '0'))"
_START = "TIMESTAMP '2026-04-01 08:00:00' + INTERVAL '37' MINUTE * conv_id"
_CWD = """CASE conv_id % 5 WHEN 0 THEN '/home/u/source/private/a'
    WHEN 1 THEN concat('C:', chr(92), 'source', chr(92), 'repos', chr(92), 'b')
    WHEN 2 THEN '/home/u/source/infra' WHEN 3 THEN '/tmp'
    ELSE '/x/source/repos/source/private' END"""
_TITLE = """CASE conv_id % 7 WHEN 0 THEN concat('[work] Plan: ', CAST(conv_id AS STRING))
    WHEN 1 THEN '  [Private]  a/b  c ' WHEN 2 THEN '[BOTH] x' WHEN 3 THEN '[nolog] y'
    WHEN 4 THEN 'plain "title"?' WHEN 5 THEN NULL ELSE '[work]' END"""
_ESCAPED = ("replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), "
            "chr(10), concat(chr(92), 'n'))")

FIXTURES: dict[str, str] = {
    "sessions": f"""
SELECT conv_id, {_SESSION.format("conv_id")} AS session_id, {_TITLE} AS raw_title, {_CWD} AS cwd,
  {_START} AS started_at
FROM (SELECT DISTINCT conv_id FROM {{conversations}}) q""",

    "turns": f"""
SELECT {_SESSION.format("conv_id")} AS session_id, turn AS line_no, role,
  (conv_id * 7 + turn) % 11 = 0 AS is_sidechain, {_START} + INTERVAL '7' HOUR * turn AS ts,
  concat(text, CASE (conv_id * 5 + turn) % 26
    WHEN 0 THEN concat(' ', 'ghp', '_', repeat('a1', 18))
    WHEN 1 THEN concat(' ', 'AK', 'IA', repeat('Z', 16))
    WHEN 2 THEN concat(' Bearer ', repeat('t', 24))
    WHEN 3 THEN concat(' postgres', '://u:p', repeat('w', 3), '@db.local')
    WHEN 4 THEN concat(' ', 'AI', 'za', repeat('k', 35))
    WHEN 5 THEN concat(chr(10), '-----BEGIN ', 'PRIVATE KEY-----', chr(10), repeat('Q', 40), chr(10), '-----END ', 'PRIVATE KEY-----')
    WHEN 6 THEN concat(' "client', 'Secret" : "', repeat('s', 9), '" ab~', repeat('x', 34))
    WHEN 7 THEN concat(' sk-', 'proj-', repeat('p', 24))
    WHEN 8 THEN concat(' sk-', repeat('a1', 18))
    WHEN 9 THEN concat(' gho', '_', repeat('o', 32), ' ghs', '_', repeat('s', 32))
    WHEN 10 THEN concat(' github', '_pat_', repeat('g_', 26))
    WHEN 11 THEN concat(' xox', 'b-', repeat('1-a', 8))
    WHEN 12 THEN concat(' ey', 'Ja.', 'ey', 'Jb.', 'c-d')
    WHEN 13 THEN concat(' DefaultEndpoints', 'Protocol=https;AccountName=n;Account', 'Key=ab+/==')
    WHEN 14 THEN concat(' pk', '_live_', repeat('v', 25))
    WHEN 15 THEN concat(' S', 'K', repeat('0f', 16))
    WHEN 16 THEN concat(' S', 'G.', repeat('a', 18), '.', repeat('b', 33))
    WHEN 17 THEN concat(' hooks.slack', '.com/services/T0A/B0B/xyz')
    WHEN 18 THEN concat(' dop', '_v1_', repeat('0f', 32))
    WHEN 19 THEN concat(' da', 'pi', repeat('0f', 16))
    WHEN 20 THEN concat(' [{{{{"value": "', repeat('u', 7), '", "key": "client', 'Secret"}}}}]')
    WHEN 21 THEN concat(' mongodb+srv', '://u:p%40@h.example and https://plain.example/a:b')
    WHEN 22 THEN concat(' -----BEGIN ', 'RSA PRIVATE KEY-----', chr(10), 'ab', chr(10), '-----END ', 'RSA PRIVATE KEY-----')
    ELSE concat(' sk-', 'ant-', repeat('b', 31), ' SHA256:', repeat('h', 43)) END) AS text
FROM {{conversations}}""",

    "blocks": f"""
SELECT {_SESSION.format("conv_id")} AS session_id, turn AS line_no, 0 AS block_no, 'text' AS type,
  CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS id, text AS body
FROM {{conversations}}
UNION ALL
SELECT {_SESSION.format("conv_id")}, turn, 1, 'tool_use',
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'ExitPlanMode' WHEN 1 THEN 'Read' WHEN 2 THEN 'Bash' ELSE 'Grep' END,
  concat('t', CAST(turn AS STRING)), concat('in ', CAST(turn AS STRING))
FROM {{conversations}} WHERE role = 'assistant'
UNION ALL
SELECT {_SESSION.format("conv_id")}, turn + 1, 2, 'tool_result', NULL,
  CASE (conv_id + turn) % 3 WHEN 0 THEN 'lost' ELSE concat('t', CAST(turn AS STRING)) END, 'out'
FROM {{conversations}} WHERE role = 'assistant'""",

    # JSON lines: string content, block arrays, plan calls, bare members, malformed lines.
    "transcript_lines": f"""
SELECT {_SESSION.format("conv_id")} AS session_id, turn AS line_no,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN '{{{{bad' ELSE
  concat('{{{{"type":"', role, '","isSidechain":', CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN 'true' ELSE 'false' END,
    ',"message":{{{{"content":', CASE turn % 3 WHEN 0 THEN concat('"', esc, '"')
      WHEN 1 THEN concat('[{{{{"type":"text","text":"', esc, '"}}}},{{{{"type":"tool_use","id":"t', CAST(turn AS STRING),
        '","name":"Read","input":{{{{"p":1}}}}}}}}]')
      ELSE CASE role WHEN 'assistant' THEN concat('[{{{{"type":"text","text":"', esc,
          '"}}}},{{{{"type":"tool_use","id":"t', CAST(turn AS STRING),
          '","name":"ExitPlanMode","input":{{{{"plan":"p', CAST(turn AS STRING), '"}}}}}}}},"bare"]')
        ELSE concat('[{{{{"type":"text","text":"', esc, '"}}}},{{{{"type":"tool_result","tool_use_id":"t',
          CAST(turn - 1 AS STRING), '","content":"out"}}}}]') END END, '}}}}}}}}') END AS raw
FROM (SELECT conv_id, turn, role, {_ESCAPED} AS esc FROM {{conversations}}) q""",

    "titles": f"""
SELECT {_SESSION.format("conv_id")} AS session_id, turn AS line_no,
  CASE turn % 3 WHEN 0 THEN concat('T', CAST(turn AS STRING)) WHEN 1 THEN '' ELSE NULL END AS title
FROM {{conversations}}""",

    # One copy of each session per date it was written on.
    "snapshots": """
SELECT session_id, store, log_date, ts, concat('copy ', CAST(n AS STRING)) AS body
FROM (SELECT session_id, CAST(ts AS DATE) AS log_date, max(ts) AS ts, max(line_no) AS n,
        CASE WHEN max(length(text)) > 300 THEN 'store_work' ELSE 'store_private' END AS store
      FROM {turns} GROUP BY session_id, CAST(ts AS DATE)) q""",

    "articles": """
SELECT doc_id, CASE WHEN n_chars > 15000 THEN 'private' WHEN doc_id % 2 = 0 THEN 'work' ELSE 'both' END AS brain,
  concat('library/', CASE doc_id % 4 WHEN 0 THEN 'patterns/' WHEN 1 THEN concat('projects/', CASE doc_id % 5 WHEN 0 THEN 'infra/' ELSE concat('p', CAST(doc_id % 13 AS STRING), '/') END)
    WHEN 2 THEN 'decisions/' ELSE '' END, CASE doc_id % 97 WHEN 96 THEN 'Doc_' ELSE 'doc-' END, CAST(doc_id AS STRING), '.md') AS path,
  concat('---', chr(10), CASE doc_id % 19 WHEN 18 THEN '' ELSE concat('title: Doc ', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN ' about long things' ELSE '' END, chr(10)) END,
    CASE doc_id % 5 WHEN 0 THEN concat('ttl: 2w', chr(10)) WHEN 1 THEN concat('ttl: 3mo', chr(10))
      WHEN 2 THEN concat('ttl: 1y  # yearly', chr(10)) WHEN 3 THEN concat('ttl: stable', chr(10)) ELSE concat('ttl:', chr(10)) END,
    CASE doc_id % 3 WHEN 0 THEN concat('scope: work', chr(10)) WHEN 1 THEN concat('scope: both', chr(10)) ELSE concat('scope: team', chr(10)) END,
    'created: 2026-0', CAST(doc_id % 4 + 1 AS STRING), CASE doc_id % 11 WHEN 10 THEN '-40' ELSE '-01' END, chr(10),
    'updated: 2026-0', CAST(doc_id % 9 + 1 AS STRING), '-15', chr(10),
    'sources: [s', lpad(CAST(doc_id % 120 AS STRING), 8, '0'), ', s', lpad(CAST((doc_id * 3) % 120 AS STRING), 8, '0'), ']', chr(10),
    CASE doc_id % 6 WHEN 0 THEN concat('share: true', chr(10)) WHEN 1 THEN concat('share: Yes', chr(10))
      WHEN 2 THEN concat('share: true # ok', chr(10)) WHEN 3 THEN concat('share: false', chr(10)) ELSE '' END,
    'related: [doc-', CAST((doc_id * 7) % 1100 AS STRING), ']', chr(10), '---', chr(10), chr(10), text, chr(10),
    CASE doc_id % 8 WHEN 0 THEN concat('- one', chr(10), '- two', chr(10)) ELSE '' END,
    'See [[doc-', CAST((doc_id * 11) % 1100 AS STRING), ']] and Doc ', CAST((doc_id * 13) % 1100 AS STRING),
    ' about long things.', chr(10)) AS content
FROM {documents}""",

    # The shared store: some articles as they are, some changed, some under old names.
    "shared": """
SELECT CASE doc_id % 10 WHEN 0 THEN concat('old/', CAST(doc_id AS STRING), '.md') ELSE replace(path, 'library/', '') END AS rel,
  CASE doc_id % 10 WHEN 1 THEN 'before' ELSE content END AS content,
  CASE doc_id % 3 WHEN 0 THEN 'ana' ELSE 'ben' END AS contributor
FROM {articles}""",

    "edits": """
SELECT brain, CAST(floor(doc_id / 10) AS BIGINT) AS run_id, CAST(doc_id % 10 AS INT) AS seq,
  CASE floor(doc_id / 10) % 2 WHEN 0 THEN 'compile' ELSE 'supervise' END AS kind,
  CASE doc_id % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'skip' WHEN 4 THEN 'rewrite' ELSE 'merge' END AS action,
  CASE doc_id % 8 WHEN 0 THEN 'notes/x.md' WHEN 1 THEN 'library/../x.md' WHEN 2 THEN 'library/index.md'
    ELSE concat('library/', CASE doc_id % 7 WHEN 0 THEN 'decisions/' ELSE 'patterns/' END, 'doc-', CAST((CAST(floor(doc_id / 4) AS BIGINT) % 13) * 100 AS STRING), '.md') END AS path,
  CASE doc_id % 5 WHEN 0 THEN NULL ELSE concat('because ', source) END AS reason,
  CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE concat('v', CAST(doc_id AS STRING)) END AS content
FROM (SELECT doc_id, source, CASE WHEN floor(doc_id / 10) % 3 = 0 THEN 'both' ELSE 'work' END AS brain FROM {documents}) q""",

    "runs": """
SELECT brain, kind, run_id, DATE '2026-05-01' + CAST(floor(run_id / 7) AS INT) AS section_date,
  concat('0', CAST(run_id % 7 AS STRING), ':30') AS hm,
  CASE run_id % 4 WHEN 0 THEN '' ELSE concat('run ', CAST(run_id AS STRING)) END AS summary
FROM (SELECT brain, kind, run_id FROM {edits} GROUP BY brain, kind, run_id
      UNION ALL SELECT 'both', 'compile', 500000 + doc_id FROM {labels} GROUP BY doc_id) q""",

    # Two attempts per run; blocks with markers in bodies, missing ends, repeated headers.
    "responses": """
SELECT doc_id AS run_id, CASE doc_id % 3 WHEN 2 THEN 'supervise' ELSE 'compile' END AS kind, attempt,
  CASE WHEN (doc_id + attempt) % 5 = 4 THEN concat('no blocks here', chr(10), text)
    WHEN (doc_id + attempt) % 5 = 3 THEN concat('@@@SUMMARY', chr(10), ' only ', CAST(doc_id AS STRING), chr(10), '@@@END')
    ELSE concat('noise', chr(10), '@@@', CASE doc_id % 3 WHEN 2 THEN 'SUPERVISE' ELSE 'EDIT' END, '  ', chr(10), 'action: merge', chr(10), 'action: create', chr(10),
      'path: library/a/d', CAST(doc_id AS STRING), '.md', chr(10), 'reason: r: with colon', chr(10), '@@@BODY', chr(10), '# T', chr(10),
      CASE (doc_id + attempt) % 5 WHEN 1 THEN concat('@@@EDIT', chr(10)) ELSE '' END, 'line  ', chr(10), chr(10),
      '@@@END', chr(10), '@@@', CASE doc_id % 3 WHEN 2 THEN 'SUPERVISE' ELSE 'EDIT' END, chr(10), 'action: skip', chr(10), 'reason: thin', chr(10), '@@@END', chr(10),
      '@@@SUMMARY', chr(10), 'sum ', CAST(doc_id AS STRING), CASE (doc_id + attempt) % 5 WHEN 2 THEN '' ELSE concat(chr(10), '@@@END') END) END AS text
FROM (SELECT doc_id, text, 1 AS attempt FROM {documents} UNION ALL SELECT doc_id, text, 2 FROM {documents}) q""",

    # History of articles: up to three versions of each, some breaking the rules of an update.
    "versions": """
SELECT brain, path, run_id, CAST(doc_id % 10 AS INT) AS seq, action,
  concat('---', chr(10), 'created: 2026-01-0', CASE WHEN action = 'update' AND doc_id % 7 = 0 THEN '2' ELSE '1' END, chr(10),
    'updated: 2026-0', CASE WHEN action = 'update' AND doc_id % 5 = 0 THEN '1' WHEN action = 'update' THEN '4' ELSE '3' END, '-01', chr(10),
    'sources: [a', CASE WHEN action = 'update' AND doc_id % 3 = 0 THEN ', c]' ELSE ', b]' END, chr(10), '---', chr(10), 'v', CAST(run_id AS STRING)) AS content
FROM (SELECT doc_id, brain, path, 10 AS run_id, CASE doc_id % 4 WHEN 3 THEN 'update' ELSE 'create' END AS action FROM {articles}
      UNION ALL SELECT doc_id, brain, path, 2000, CASE doc_id % 6 WHEN 5 THEN 'delete' ELSE 'update' END FROM {articles}
      UNION ALL SELECT doc_id, brain, path, 2001, CASE doc_id % 5 WHEN 4 THEN 'delete' ELSE 'update' END FROM {articles}) q""",

    # Logs that their stores hold already, some in the store that the session belongs to.
    "filed": """
SELECT session_id, CAST(ts AS DATE) AS log_date, CASE line_no % 4 WHEN 0 THEN 'store_private' ELSE 'store_work' END AS store, line_no, length(text) AS n
FROM {turns} WHERE line_no % 3 <> 1""",

    # Hook payloads as JSON text; errors stand for broken lines, sign-ups carry no session.
    "hook_lines": """
SELECT event_id, CASE event_type WHEN 'error' THEN '{{bad' WHEN 'signup' THEN concat('{{"mode":"stop","event_id":', CAST(event_id AS STRING), '}}')
  ELSE concat('{{"session_id":"s', lpad(CAST(user_id AS STRING), 8, '0'), '","cwd":"/home/u/source/infra","mode":"',
    CASE event_type WHEN 'purchase' THEN 'stop' ELSE 'prompt' END, '","event_id":', CAST(event_id AS STRING), ',"prompt":"k ', CAST(event_id % 9 AS STRING), '"}}') END AS value
FROM {events}""",

    # The same stream, typed, with the scope each session had at that time.
    "hook_events": """
SELECT event_id, ts, concat('s', lpad(CAST(user_id AS STRING), 8, '0')) AS session_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'prompt' ELSE 'stop' END AS mode,
  CASE event_type WHEN 'signup' THEN '[work] set up' WHEN 'error' THEN '[nolog] gone' WHEN 'purchase' THEN '[private] bill' ELSE NULL END AS raw_title,
  CASE user_id % 3 WHEN 0 THEN '/home/u/source/infra' ELSE '/tmp' END AS cwd,
  concat('see ', props, CASE event_type WHEN 'view' THEN concat(' redis', '://u:pw@', 'cache') ELSE '' END) AS prompt
FROM {events}""",
}

_HOLE = re.compile(r"\{(\w+)\}")


def _fill(sql: str, given) -> str:
    """Replace {names} and halve doubled braces."""
    marked = sql.replace("{{", "\x01").replace("}}", "\x02")
    return _HOLE.sub(lambda m: given(m.group(1)), marked).replace("\x01", "{").replace("\x02", "}")


# Text tables whose rows cost much more to work on than to move, and the key to spread them by.
SPREAD_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}
TEXT_FIXTURES = ("articles", "turns", "transcript_lines")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A given table. With `spread`, a text table stored as fewer splits than there are cores is spread over
    all of them; larger tables have more splits than cores and are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and name in SPREAD_KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, *SPREAD_KEYS[name])
    return df


def spark_sql(name: str, view) -> str:
    """Fixture text for Spark; `view` gives the name of a given table."""
    def given(ref: str) -> str:
        return view(ref) if ref in TABLES else f"({spark_sql(ref, view)})"
    return _fill(FIXTURES[name], given)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spread = name in TEXT_FIXTURES

    def view(ref: str) -> str:
        alias = f"given_{ref}_{int(spread)}_{zlib.crc32(sf_dir.encode()):08x}"
        table(spark, sf_dir, ref, spread).createOrReplaceTempView(alias)
        return alias
    return spark.sql(spark_sql(name, view))


def _needed(sql: str, ctes: dict[str, str], out: dict[str, None]) -> None:
    for ref in _HOLE.findall(sql.replace("{{", "").replace("}}", "")):
        if ref in ctes and ref not in out:
            _needed(ctes[ref], ctes, out)
            out[ref] = None


def duckdb_sql(query: str, extra: dict[str, str] | None = None) -> str:
    """`query` with the {fixtures} (and `extra` ones) it names as common table expressions."""
    ctes = {**FIXTURES, **(extra or {})}
    needed: dict[str, None] = {}
    _needed(query, ctes, needed)
    body = _fill(query, lambda r: r).strip()
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({_fill(ctes[n], lambda r: r)})" for n in needed)
    return f"WITH {head}\n{body}"
