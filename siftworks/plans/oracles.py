"""For each query, the SQL another database can run on the same tables to check it."""

from __future__ import annotations

from collections.abc import Iterable

from siftworks.functions.genres import GENRES
from siftworks.functions.rules import Rule, default_rules
from siftworks.functions.severity import LEVELS
from siftworks.functions.text import WHITE_SPACE
from siftworks.plans import derive, registry

ORACLES: dict[str, str] = {}

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_SHOWN = "rule_name, severity, matched_text, line_content"


def _text(value: str) -> str:
    """A string literal; line breaks are spelled out."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n")) + ")"


def _lines(source: str, keys: str) -> str:
    return f"""
    SELECT {keys}, CAST(i AS INTEGER) AS line_no,
           CASE WHEN i < n AND right(piece, 1) = chr(13) THEN left(piece, length(piece) - 1) ELSE piece END AS line
    FROM (SELECT {keys}, unnest(parts) AS piece, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS n
          FROM (SELECT {keys}, string_split(text, chr(10)) AS parts FROM ({source})))
    WHERE NOT (i = n AND piece = '')"""


def _shorten(token: str) -> str:
    kept = " ".join(f"WHEN strlen(left({token}, {k})) <= 4 THEN left({token}, {k})" for k in (4, 3, 2, 1))
    return f"CASE WHEN strlen({token}) > 8 THEN (CASE {kept} ELSE '' END) || '…[redacted]' ELSE '[redacted]' END"


def _matches(lines: str, keys: str, rules: Iterable[Rule], redact: bool = True, env: str = "false") -> str:
    """One SELECT per rule over ``lines(keys..., line)``."""
    selects = []
    for rule in rules:
        if rule.env_only and env == "false":
            continue
        pattern = _text(rule.pattern)
        where = f"regexp_matches(line, {pattern})"
        if rule.allowlist:
            where += f" AND NOT regexp_matches(line, {_text(rule.allowlist)})"
        if rule.env_only:
            where += f" AND ({env})"
        token = f"regexp_extract(line, {pattern}, 0)"
        shown = _shorten(token) if redact else token
        content = f"regexp_replace(line, {pattern}, '[redacted]')" if redact else "line"
        selects.append(
            f"SELECT {keys}, '{rule.name}' AS rule_name, '{rule.severity}' AS severity, "
            f"{shown} AS matched_text, rtrim({content}, {_BLANKS}) AS line_content FROM {lines} WHERE {where}"
        )
    return " UNION ALL ".join(selects)


def _scan(source: str, keys: str, rules: Iterable[Rule] | None = None, redact: bool = True, env: str = "false",
          extra: str = "") -> str:
    carried = keys + (", " + extra if extra else "")
    chosen = default_rules() if rules is None else rules
    return (
        f"WITH lines AS MATERIALIZED ({_lines(source, carried)}) "
        f"{_matches('lines', keys + ', line_no', chosen, redact, env)}"
    )


_DOCS = "SELECT doc_id, text FROM documents"
_PLANTED = f"SELECT doc_id, {derive.PLANTED_TEXT} AS text FROM documents"
_HIGH = [r for r in default_rules() if r.severity in LEVELS[2:]]

ORACLES["scan_documents"] = _scan(_DOCS, "doc_id")
ORACLES["scan_pages"] = _scan("SELECT page_id, html AS text FROM pages", "page_id")
ORACLES["scan_conversations"] = _scan(
    f"SELECT conv_id, turn, {derive.planted_text('conv_id')} AS text FROM conversations", "conv_id, turn"
)
ORACLES["scan_benchmark"] = _scan(f"SELECT item_id, {derive.planted_text('item_id')} AS text FROM benchmark", "item_id")
ORACLES["scan_planted_all_rules"] = _scan(_PLANTED, "doc_id", env="true")
ORACLES["scan_redacted"] = _scan(_PLANTED, "doc_id")
ORACLES["scan_unredacted"] = _scan(_PLANTED, "doc_id", redact=False)
_CUSTOM = [Rule("custom-0", "HIGH", registry.CUSTOM_PATTERN)]
ORACLES["scan_custom_rule"] = _scan(_DOCS, "doc_id", _CUSTOM)
ORACLES["scan_linear_rules"] = _scan(
    _DOCS, "doc_id", [Rule(f"custom-{i}", "HIGH", p) for i, p in enumerate(registry.LINEAR_PATTERNS)]
)
ORACLES["scan_default_and_custom_rules"] = _scan(_PLANTED, "doc_id", [*default_rules(), *_CUSTOM])
ORACLES["scan_directory"] = _scan(
    f"""SELECT lang || '/d' || doc_id || '.py' AS path, {derive.PLANTED_TEXT} AS text FROM documents
    WHERE lang <> 'fr' AND doc_id <> 7""", "path"
)
ORACLES["scan_no_infra"] = _scan(
    _PLANTED, "doc_id", [r for r in default_rules() if not r.name.startswith("infra-") and r.name != "user-dir-path"]
)
ORACLES["scan_min_high"] = _scan(_PLANTED, "doc_id", _HIGH)
ORACLES["min_severity"] = ORACLES["scan_min_high"]
ORACLES["allowlist_effect"] = _scan(f"SELECT doc_id, {derive.EXCUSED_TEXT} AS text FROM documents", "doc_id")
ORACLES["scan_stream"] = ORACLES["scan_documents"]

_FILES = (
    f"SELECT doc_id, {derive.REPO} AS repo, {derive.PATH} AS path, {derive.PLANTED_TEXT} AS text FROM documents"
)
_NAME = "string_split(path, '/')[-1]"
_ENV = f"({_NAME} = 'env' OR contains({_NAME}, '.env'))"
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1))"
_BINARY = f"{_EXT} IN ('png', 'lock')"
_AUTO = "('node_modules', '.git', 'target', 'dist', '__pycache__', '.next', '.venv', 'venv')"
_IGNORED = f"len(list_filter(string_split(path, '/'), lambda c: c IN {_AUTO})) > 0"

ORACLES["env_gate"] = _scan(
    _FILES, "repo, path", [r for r in default_rules() if r.env_only], env=_ENV
)
ORACLES["lines_of_documents"] = f"SELECT doc_id, line_no, md5(line) AS line_md5 FROM ({_lines(_DOCS, 'doc_id')})"
ORACLES["decode_text"] = """
    SELECT 'd' || doc_id AS path,
           length(text) + CASE doc_id % 10 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 7 THEN 4 ELSE 0 END AS chars
    FROM documents WHERE doc_id % 10 IN (2, 3, 4, 7, 8, 9)"""
ORACLES["files_after_path_filters"] = f"""
    SELECT repo, path, {_ENV} AS is_env, {_EXT} AS ext FROM ({_FILES}) WHERE NOT {_IGNORED} AND NOT {_BINARY}"""
# patterns: the folder vendor/ at the root, the name app, an unused line, the name d7.py
_TREE_IGNORED = """(path LIKE 'vendor/%' OR path = 'app' OR path LIKE '%/app' OR path LIKE 'app/%' OR path LIKE '%/app/%'
    OR path = 'd7.py' OR path LIKE '%/d7.py')"""
_LOG_IGNORED = "(path LIKE 'vendor/%' OR path = 'app' OR path LIKE '%/app' OR path = 'd7.py' OR path LIKE '%/d7.py')"
ORACLES["scanignore_tree"] = f"SELECT repo, path FROM ({_FILES}) WHERE NOT {_TREE_IGNORED}"
ORACLES["scanignore_history"] = f"SELECT repo, path FROM ({_FILES}) WHERE NOT {_LOG_IGNORED}"
ORACLES["paths_anti_ignores"] = ORACLES["scanignore_tree"]

_TREE = f"SELECT repo, path, text FROM ({_FILES}) WHERE NOT {_IGNORED} AND NOT {_BINARY}"
_TREE_SCAN = _scan(_TREE, "repo, path", env=_ENV)
ORACLES["scan_tree"] = _scan(
    f"{_TREE} AND NOT {_TREE_IGNORED} AND NOT path LIKE 'src/app/%'", "repo, path", env=_ENV
)
ORACLES["dedup_findings"] = f"""
    SELECT repo, 'file:' || path || ':' || line_no AS loc_key, rule_name, matched_text FROM ({_TREE_SCAN})"""

# (level folder, number, negated, folder only, test on the whole sub-path, test on the last component)
_IGNORE_RULES = (
    ("", 1, False, False, None, r"^[^/]*\.env$"),
    ("", 2, False, False, None, r"^\.env[^/]*$"),
    ("", 3, False, True, "^vendor$", None),
    ("", 4, True, False, "^keep/.+$", None),
    ("", 5, False, False, r"^(.*/)?app/d1[^/]*\.js$", None),
    ("", 6, False, False, "^build/.+$", None),
    ("", 7, False, False, None, r"^[^/]*\.lock$"),
    ("", 8, True, False, None, r"^d[0-4][^/]*\.lock$"),
    ("", 9, False, False, None, r"^d[^/][5-9]\.md$"),
    ("docs", 1, False, False, r"^vendor/d[^/]*\.js$", None),
    ("docs", 2, True, False, None, r"^[^/]*\.env$"),
    ("docs", 3, False, False, None, r"^[^/]*\.png$"),
)
_NEGATION_RULES = (
    ("", 1, False, False, None, r"^[^/]*\.env$"),
    ("", 2, False, False, None, r"^[^/]*\.js$"),
    ("", 3, True, False, None, r"^d1[^/]*\.js$"),
    ("docs/vendor", 1, True, False, None, r"^[^/]*\.env$"),
    ("docs/vendor", 2, True, False, None, r"^[^/]*\.js$"),
)


def _covered(files: str, rules: tuple) -> str:
    values = ", ".join(
        f"('{level}', {no}, {negated}, {folder}, {whole is not None}, '{whole or base}')"
        for level, no, negated, folder, whole, base in rules
    )
    return f"""
    WITH ignore_rules(level, no, negated, folder, whole, test) AS (VALUES {values}),
    subs AS (SELECT DISTINCT f.repo, f.path, r.level,
                    CASE WHEN r.level = '' THEN f.path ELSE substr(f.path, length(r.level) + 2) END AS sub
             FROM ({files}) f JOIN (SELECT DISTINCT level FROM ignore_rules) r
               ON r.level = '' OR starts_with(f.path, r.level || '/')),
    candidates AS (SELECT repo, path, level, k, k < len(string_split(sub, '/')) AS is_folder,
                          array_to_string(string_split(sub, '/')[1:k], '/') AS candidate
                   FROM (SELECT *, unnest(range(1, len(string_split(sub, '/')) + 1)) AS k FROM subs)),
    verdicts AS (SELECT c.repo, c.path, c.level, c.k, arg_max(r.negated, r.no) AS negated
                 FROM candidates c JOIN ignore_rules r
                   ON c.level = r.level AND (c.is_folder OR NOT r.folder)
                  AND regexp_matches(CASE WHEN r.whole THEN c.candidate ELSE string_split(c.candidate, '/')[-1] END, r.test)
                 GROUP BY c.repo, c.path, c.level, c.k)
    SELECT DISTINCT repo, path FROM verdicts WHERE NOT negated"""


_COVERED = _covered(_FILES, _IGNORE_RULES)
ORACLES["gitignore_coverage"] = _COVERED
ORACLES["gitignore_negation"] = _covered(_FILES, _NEGATION_RULES)
_RULE_FLAGS = ", ".join(
    f"('{level}', {no - 1}, {negated}, {folder}, {whole is not None})"
    for level, no, negated, folder, whole, _ in _IGNORE_RULES
)
ORACLES["gitignore_rules"] = f"""
    SELECT repo, level_dir, rule_no, negated, dir_only, anchored
    FROM (SELECT DISTINCT source AS repo FROM documents),
         (VALUES {_RULE_FLAGS}) AS r(level_dir, rule_no, negated, dir_only, anchored)"""
_STATUS = f"""
    SELECT f.repo AS repo, f.path AS path, f.line_no AS line_no, rule_name, severity, matched_text, line_content,
           c.path IS NOT NULL AS git_ignored, CASE WHEN c.path IS NULL THEN 'active' ELSE 'covered' END AS status
    FROM ({_TREE_SCAN}) f LEFT JOIN ({_COVERED}) c ON f.repo = c.repo AND f.path = c.path"""
ORACLES["partition_covered"] = f"SELECT repo, path, line_no, rule_name, status FROM ({_STATUS})"
ORACLES["findings_counts"] = f"SELECT status, count(*) AS findings FROM ({_STATUS}) GROUP BY status"
ORACLES["gate"] = f"""
    SELECT count(*) FILTER (status = 'active') AS active_count, count(*) FILTER (status = 'covered') AS covered_count,
           count(*) FILTER (status = 'active') = 0 AS passed
    FROM ({_STATUS}) WHERE severity IN ('HIGH', 'CRITICAL')"""
ORACLES["findings_rollup"] = f"""
    SELECT severity, rule_name, lang, grouping(severity, rule_name, lang) AS level, count(*) AS findings
    FROM ({_scan(f"SELECT lang, {derive.PLANTED_TEXT} AS text FROM documents", "lang")})
    GROUP BY ROLLUP (severity, rule_name, lang)"""
ORACLES["findings_by_label"] = f"""
    SELECT quality, toxic, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings
    FROM labels LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({ORACLES["scan_redacted"]}) GROUP BY doc_id) USING (doc_id)
    GROUP BY quality, toxic"""
ORACLES["findings_json"] = f"""
    SELECT status, CAST(json_object('rule_name', rule_name, 'severity', severity,
        'location', json_object('source', 'file', 'path', path, 'line_no', line_no),
        'matched_text', matched_text, 'line_content', line_content, 'git_ignored', git_ignored) AS VARCHAR) AS json
    FROM ({_STATUS})"""
ORACLES["findings_report"] = f"""
    SELECT CASE WHEN git_ignored THEN '[COVERED]' ELSE '[' || severity || ']' END || ' ' || rule_name || '  ' || path || ':'
        || line_no || chr(10) || '      match:   ' || matched_text || chr(10) || '      line:    ' || line_content || chr(10)
        AS block
    FROM ({_STATUS})"""
ORACLES["findings_json_sink"] = f"""
    SELECT status, rule_name, git_ignored, count(*) AS findings FROM ({_STATUS}) GROUP BY ALL"""

# --- history ----------------------------------------------------------------------

_LOG_LINES = f"""
    SELECT * FROM ({_lines(
        f"SELECT doc_id, {derive.REPO} AS repo, {derive.COMMIT_HASH} AS hash, {derive.COMMIT_FILE} AS file, lang, "
        f"{derive.PLANTED_TEXT} AS text FROM documents WHERE {derive.PARENTS} = 1",
        "doc_id, repo, hash, file, lang")}) WHERE NOT starts_with(line, 'D')"""


def _history(redact: bool, dedup: bool, where: str = "true") -> str:
    found = f"""
    WITH lines AS MATERIALIZED (SELECT * FROM ({_LOG_LINES}) WHERE {where}),
    found AS ({_matches("lines", "doc_id, repo, hash, file, lang, line_no", default_rules(), redact, "file = 'conf/.env'")}),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, rule_name, file, matched_text
                                              ORDER BY -doc_id, line_no) AS nth FROM found)
    SELECT repo, -doc_id AS commit_pos, CAST(line_no AS BIGINT) AS seq, hash, left(hash, 8) AS short_hash, file,
           CASE WHEN lang = 'fr' THEN '' ELSE 'import ' || doc_id END AS commit_message, {_SHOWN}
    FROM numbered"""
    return found + (" WHERE nth = 1" if dedup else "")


ORACLES["history_findings"] = _history(True, False)
ORACLES["history_dedup_redacted"] = _history(True, True)
ORACLES["history_dedup_raw"] = _history(False, True, "file NOT LIKE 'vendor/%' AND file NOT LIKE '%/fr.py'")
ORACLES["walk_order"] = f"""
    SELECT repo, hash, commit_pos, row_number() OVER (PARTITION BY repo ORDER BY commit_pos, hash) AS rank
    FROM (SELECT source AS repo, {derive.COMMIT_HASH} AS hash, -doc_id AS commit_pos FROM documents)"""
ORACLES["skip_merges"] = f"""
    SELECT source AS repo, left({derive.COMMIT_HASH}, 8) AS short_hash, -doc_id AS commit_pos,
           coalesce({derive.SUMMARY}, '') AS summary
    FROM documents WHERE doc_id % 7 <> 0"""
ORACLES["history_lines"] = f"""
    SELECT repo, file, count(*) AS lines, count(DISTINCT hash) AS commits, CAST(sum(length(line)) AS BIGINT) AS chars
    FROM ({_LOG_LINES}) GROUP BY repo, file"""

_BASE = "SELECT 'd' || doc_id || '.py' AS path, replace(text, 'the', 'THE') AS text FROM documents"
_NEW = (
    "SELECT 'd' || doc_id || '.py' AS path, text || chr(10) || string_split(text, chr(10))[1] || chr(10) || "
    f"{derive.PLANT} AS text FROM documents"
)
_ADDED = f"""
    SELECT path, line_no, line
    FROM (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY line_no) AS nth FROM ({_lines(_NEW, "path")}))
    LEFT JOIN (SELECT path, line, count(*) AS had FROM ({_lines(_BASE, "path")}) GROUP BY path, line) USING (path, line)
    WHERE nth > coalesce(had, 0)"""
ORACLES["delta_lines"] = f"SELECT path, line_no, md5(line) AS line_md5 FROM ({_ADDED})"
ORACLES["scan_delta"] = (
    f"WITH lines AS MATERIALIZED (SELECT path, line_no, rtrim(line, chr(13)) AS line FROM ({_ADDED})) "
    + _matches("lines", "path, line_no", default_rules())
)
ORACLES["scan_repository"] = f"""
    SELECT repo, 'file' AS source, rule_name, git_ignored, count(*) AS findings FROM ({_STATUS}) GROUP BY ALL
    UNION ALL
    SELECT repo, 'commit' AS source, rule_name, false AS git_ignored, count(*) AS findings
    FROM ({_history(True, True)}) GROUP BY ALL"""

# --- bytes: all work is done on hex text, two digits per byte -----------------------------

_BLOBS = f"""SELECT doc_id, 'd' || doc_id AS path, h, CAST(length(h) // 2 AS BIGINT) AS n
             FROM (SELECT doc_id, {derive.BLOB_HEX} AS h FROM documents)"""


def _cut(start: str, count: str | None = None, h: str = "h") -> str:
    tail = "" if count is None else f", 2 * greatest({count}, 0)"
    return f"substr({h}, 2 * ({start}) + 1{tail})"


def _resolved(offset: str) -> str:
    return f"CASE WHEN {offset} < 0 THEN greatest(n + {offset}, 0) ELSE {offset} END"


_SPAN = f"SELECT *, doc_id % 97 - 48 AS first, doc_id * 31 % 701 - 350 AS last FROM ({_BLOBS})"
_CELLS = "rtrim(regexp_replace(lower({0}), '(..)', '\\1 ', 'g'))"
ORACLES["manifest"] = f"SELECT path, n AS length, sha256(unhex(h)) AS sha256 FROM ({_BLOBS})"
ORACLES["byte_range_cli"] = f"""
    SELECT path, CASE WHEN s >= 0 AND e >= s THEN {_CELLS.format(_cut("s", "e - s + 1"))} ELSE '' END AS cells,
           md5({_cut("c")}) AS to_end_md5
    FROM (SELECT *, CASE WHEN first < 0 THEN n + first ELSE first END AS s,
                 CASE WHEN last < 0 THEN n + last ELSE last END AS e, {_resolved("first")} AS c FROM ({_SPAN}))"""
ORACLES["byte_range_gui"] = f"""
    SELECT path, CASE WHEN s > e OR s >= n THEN '' WHEN e < n THEN {_cut("s", "e - s + 1")} END AS bytes_hex,
           CASE WHEN s <= e AND s < n AND e >= n THEN 'failed to fill whole buffer' END AS error
    FROM (SELECT *, {_resolved("first")} AS s, {_resolved("last")} AS e FROM ({_SPAN}))"""
ORACLES["byte_page"] = f"""
    SELECT path, {_cut("s", "512")} AS page_hex FROM (SELECT *, greatest(doc_id * 13 % 2000 - 100, 0) AS s FROM ({_BLOBS}))"""
ORACLES["read_bytes_padded"] = f"""
    SELECT path, rpad({_cut("doc_id * 7 % 400", "48")}, 96, '0') AS bytes_hex FROM ({_BLOBS})"""
ORACLES["hex_cells"] = f"SELECT path, md5({_CELLS.format('h')}) AS cells_md5 FROM ({_BLOBS})"
_DUMP = f"""
    SELECT path, row_offset, printf('%08X', row_offset) AS "offset", {_cut("row_offset", "16")} AS cells
    FROM (SELECT *, unnest(range(0, n, 16)) AS row_offset FROM ({_BLOBS}))"""
# the gutter: a byte is printable when its two digits are between 20 and 7E
ORACLES["hex_dump_rows"] = f"""
    SELECT path, row_offset, "offset", rtrim(regexp_replace(cells, '(..)', '\\1 ', 'g')) AS hex,
           array_to_string(list_transform(regexp_extract_all(cells, '..'),
               lambda c: CASE WHEN c BETWEEN '20' AND '7E' THEN chr(CAST('0x' || c AS INTEGER)) ELSE '.' END), '') AS ascii
    FROM ({_DUMP})"""
ORACLES["header4"] = f"""
    SELECT path, CASE WHEN n >= 4 THEN rtrim(regexp_replace(lower(left(h, 8)), '(..)', '0x\\1 ', 'g')) END AS header
    FROM ({_BLOBS})"""
_KIND_CLI = """CASE WHEN n < 2 THEN NULL WHEN left(h, 4) = 'FFD8' AND right(h, 4) = 'FFD9' THEN 'jpg'
    WHEN left(h, 8) = '89504E47' THEN 'png' WHEN left(h, 8) = '47494638' THEN 'gif' WHEN left(h, 4) = '424D' THEN 'bmp'
    WHEN left(h, 4) = '4D5A' THEN 'exe' WHEN left(h, 8) IN ('CAFEBABE', 'CAFED00D') THEN 'class' ELSE 'unknown' END"""
ORACLES["detect_type_cli"] = f"SELECT path, {_KIND_CLI} AS file_type FROM ({_BLOBS})"
ORACLES["detect_type_gui"] = f"""
    SELECT path, CASE WHEN n < 2 THEN 'unknown' WHEN left(h, 4) = 'FFD8' THEN 'jpg' WHEN left(h, 8) = '89504E47' THEN 'png'
        WHEN left(h, 8) = '47494638' THEN 'gif' WHEN left(h, 4) = '424D' THEN 'bmp' WHEN left(h, 4) = '4D5A' THEN 'exe'
        WHEN left(h, 8) = 'CAFEBABE' THEN 'class' WHEN left(h, 8) = '25504446' THEN 'pdf' ELSE 'unknown' END AS file_type
    FROM ({_BLOBS})"""
ORACLES["detected_types"] = f"""
    SELECT {_KIND_CLI} AS file_type, count(*) AS blobs, CAST(sum(n) AS BIGINT) AS bytes FROM ({_BLOBS}) GROUP BY 1"""


def _strings(source: str, key: str, least: int) -> str:
    """Every character beyond ASCII becomes as many separators as it has bytes, so positions are byte offsets."""
    flat = "text"
    for low, high, count in (("80", "7FF", 2), ("800", "FFFF", 3), ("10000", "10FFFF", 4)):
        flat = f"regexp_replace({flat}, '[\\x{{{low}}}-\\x{{{high}}}]', repeat(chr(1), {count}), 'g')"
    return f"""
    SELECT {key}, CAST("offset" AS BIGINT) AS "offset", value
    FROM (SELECT {key}, value,
                 sum(length(value) + 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 - length(value) - 1 AS "offset"
          FROM (SELECT {key}, unnest(parts) AS value, unnest(range(len(parts))) AS i
                FROM (SELECT {key}, string_split_regex({flat}, '[^\\t\\n\\r -~]') AS parts FROM ({source}))))
    WHERE length(value) >= {least}"""


_HTML = "SELECT page_id, html AS text FROM pages"
ORACLES["scan_strings_documents"] = _strings(_DOCS, "doc_id", 4)
ORACLES["scan_strings_pages"] = _strings(_HTML, "page_id", 12)
ORACLES["strings_matching"] = f"SELECT * FROM ({_strings(_HTML, 'page_id', 4)}) WHERE contains(lower(value), 'href')"
ORACLES["strings_kept"] = f"""
    SELECT count(*) FILTER (contains(lower(value), 'href')) AS kept, count(*) AS total
    FROM ({_strings(_HTML, "page_id", 4)})"""
_GENRES = ", ".join(f"({i}, {_text(name)})" for i, name in enumerate(GENRES))
ORACLES["id3v1_trailer"] = f"""
    SELECT doc_id, true AS is_tag, source AS title, lang AS artist, 'album ' || (doc_id % 9) AS album, '2024' AS year,
           '' AS comment, CAST(doc_id % 140 AS INTEGER) AS genre_code, coalesce(genre, 'Unknown') AS genre
    FROM documents LEFT JOIN (VALUES {_GENRES}) AS g(code, genre) ON doc_id % 140 = code"""
ORACLES["copied_files"] = """
    SELECT 'd' || doc_id || '.txt' AS path, true AS done, sha256(text) AS sha256 FROM documents"""
ORACLES["verify_copies"] = f"""
    SELECT path, sha256(unhex(h)) AS source_sha256,
           sha256(unhex(CASE WHEN left(h, 4) = 'FFD8' THEN substr(h, 9) ELSE h END)) AS copy_sha256,
           left(h, 4) <> 'FFD8' AS identical
    FROM ({_BLOBS})"""

# --- edits -----------------------------------------------------------------------------

_COMMANDS = f"""
    SELECT *, length(d) // 2 AS m, {_resolved("pos")} AS p, {_resolved("till")} AS q
    FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN pos + 1 WHEN doc_id % 2 = 0 THEN pos - length(d) // 2
                         ELSE pos + length(d) // 2 END AS till
          FROM (SELECT *, doc_id * 37 % (2 * n + 6) - n AS pos, hex(encode('DATA' || doc_id)) AS d,
                       hex(encode(reverse('DATA' || doc_id))) AS rd, doc_id % 3 = 0 AS grow, doc_id % 5 = 0 AS turn
                FROM ({_BLOBS})))"""
_ZEROS = "repeat('00', greatest({0}, 0)::INT)"


def _result(expression: str, source: str = _COMMANDS, more: str = "") -> str:
    return f"""
    SELECT path, CAST(length(r) // 2 AS BIGINT) AS length, md5(r) AS content_md5{more}
    FROM (SELECT *, {expression} AS r FROM ({source}))"""


_T = "CASE WHEN turn THEN rd ELSE d END"
_INSIDE = f"{_cut('0', 'p')} || {_cut('0', 'least(m, n - p)', _T)} || {_cut('p + least(m, n - p)')}"
_PADDED = f"{_cut('0', 'p')} || {_ZEROS.format('p - n')} || {_T}"
_OVERWRITE_AT = f"""CASE WHEN p < n AND grow THEN {_INSIDE} || {_cut('least(m, n - p)', None, _T)}
    WHEN p < n THEN {_INSIDE} WHEN p = n OR grow THEN {_PADDED} ELSE h END"""
_INSERT_AT = f"{_cut('0', 'p')} || {_ZEROS.format('p - n')} || {_T} || {_cut('p')}"
ORACLES["overwrite_at_cli"] = _result(_OVERWRITE_AT)
ORACLES["overwrite_at_gui"] = _result(
    f"CASE WHEN p > n AND NOT grow THEN NULL WHEN p > n THEN {_PADDED} ELSE {_INSIDE} END",
    more=", CASE WHEN p > n AND NOT grow THEN 'Offset past EOF; use append_zero_past_eof flag' END AS error",
)
_BOTH = f"SELECT *, least(p, q) AS lo, greatest(p, q) AS hi FROM ({_COMMANDS})"
_TURNED = "CASE WHEN p > q OR turn THEN rd ELSE d END"
_WRITTEN = f"{_cut('0', 'lo')} || {_cut('0', 'n - lo', _TURNED)} || {_cut('hi')}"
ORACLES["overwrite_range_cli"] = _result(
    f"""CASE WHEN m <> hi - lo THEN h WHEN grow THEN {_WRITTEN} || {_ZEROS.format(f'hi - length({_WRITTEN}) // 2')}
        ELSE {_WRITTEN} END""",
    _BOTH,
)
_BOTH_GUI = f"""SELECT * REPLACE (least(p, q) AS lo, greatest(p, q) AS hi)
    FROM (SELECT * REPLACE ({_resolved("(till - 1)")} AS q), 0 AS lo, 0 AS hi FROM ({_COMMANDS}))"""
_BOTH_GUI = f"""SELECT * EXCLUDE (lo, hi), least(p, q) AS lo, greatest(p, q) AS hi FROM ({_BOTH_GUI})"""
ORACLES["overwrite_range_gui"] = _result(
    f"""CASE WHEN m = hi - lo + 1 THEN {_cut('0', 'lo')} || {_ZEROS.format('lo - n')}
        || CASE WHEN (p > q) <> turn THEN rd ELSE d END || {_cut('hi + 1')} END""",
    _BOTH_GUI,
    f""", CASE WHEN m <> hi - lo + 1 THEN 'Data length (' || m || ') must match range length (' || (hi - lo + 1)
        || ') for overwrite' END AS error""",
)
ORACLES["insert_at_cli"] = _result(_INSERT_AT)
ORACLES["insert_at_gui"] = _result(f"{_cut('0', 'p')} || {_T} || {_cut('p')}")
ORACLES["insert_range"] = _result(f"{_cut('0', 'lo')} || {_ZEROS.format('lo - n')} || {_TURNED} || {_cut('lo')}", _BOTH)
# offsets 0 and the lowest number are the start, the others lie beyond what a value can hold
_AT_START = "doc_id % 4 IN (0, 1)"
ORACLES["offsets_at_the_ends"] = f"""
    SELECT path, md5(CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 1 THEN h ELSE '' END) AS range_md5,
           CASE WHEN {_AT_START} THEN md5(d || h) END AS inserted_md5,
           CASE WHEN {_AT_START} THEN md5({_cut('0', 'least(m, n)', 'd')} || {_cut('least(m, n)')} || {_cut('least(m, n)', None, 'd')}) END
               AS written_md5
    FROM (SELECT *, hex(encode('DATA' || doc_id)) AS d, length(hex(encode('DATA' || doc_id))) // 2 AS m FROM ({_BLOBS}))"""
ORACLES["append_eof"] = _result(f"h || {_T}")
ORACLES["reverse_bytes"] = _result(
    "array_to_string(list_reverse(regexp_extract_all(h, '..')), '')", _BLOBS
)
ORACLES["patch_hex"] = f"""
    SELECT path, CASE WHEN error IS NULL THEN md5({_cut('0', 'p')} || left(typed, 2 * w) || {_cut('p + w')}) END AS content_md5,
           CASE WHEN error IS NULL THEN w END AS bytes_written, CASE WHEN error IS NULL THEN p END AS start, error
    FROM (SELECT *, CAST(least(length(typed) // 2, n - p) AS BIGINT) AS w,
                 CASE WHEN length(typed) % 2 <> 0 THEN 'hex bytes must have an even number of hex digits'
                      WHEN typed = '' THEN 'no hex bytes provided'
                      WHEN p >= n THEN 'offset 0x' || printf('%X', p) || ' is at or past EOF (' || n || ')' END AS error
          FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'ABC'
                               ELSE 'DEAD' || printf('%X', doc_id + 4096) END AS typed FROM ({_COMMANDS})))"""
_WITH_PAYLOAD = f"""
    SELECT c.* EXCLUDE (d, rd, m, p, pos), CASE WHEN c.doc_id % 17 = 0 THEN 0 ELSE c.p END AS p,
           coalesce(o.d, c.d) AS d, coalesce(o.rd, c.rd) AS rd, length(coalesce(o.d, c.d)) // 2 AS m
    FROM ({_COMMANDS}) c
    LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN substr(h, 81) ELSE h END AS d,
                      array_to_string(list_reverse(regexp_extract_all(
                          CASE WHEN doc_id % 10 = 0 THEN substr(h, 81) ELSE h END, '..')), '') AS rd
               FROM ({_BLOBS})) o
      ON c.doc_id % 5 = 1 AND o.doc_id = c.doc_id - 1"""
# 'x' is 0 for the cli and no number for the gui; ranges (doc_id % 19 = 0) end at ``till`` or do not parse
_GUI = "(doc_id % 3 = 1)"
_TYPED_EOF, _TYPED_X = "doc_id % 13 = 0", "doc_id % 17 = 0 AND doc_id % 13 <> 0"
_RANGED = "(doc_id % 19 = 0)"
_EDIT_ERROR = f"""CASE WHEN doc_id % 25 = 1 THEN 'there is no data to write'
    WHEN {_GUI} AND ({_TYPED_EOF} OR {_TYPED_X} OR doc_id % 38 = 19) THEN 'an offset is not a number'
    WHEN NOT {_GUI} AND {_RANGED} AND ({_TYPED_EOF} OR {_TYPED_X} OR doc_id % 38 = 19) THEN 'an offset is not a number'
    WHEN {_GUI} AND {_RANGED} AND doc_id % 2 = 0 AND m <> hi - lo + 1
        THEN 'Data length (' || m || ') must match range length (' || (hi - lo + 1) || ') for overwrite'
    WHEN {_GUI} AND NOT {_RANGED} AND doc_id % 2 = 0 AND p > n AND NOT grow THEN 'Offset past EOF; use append_zero_past_eof flag'
    END"""
_EDIT_GUI = f"""CASE WHEN doc_id % 2 = 1 THEN {_cut('0', 'p')} || {_T} || {_cut('p')}
    WHEN {_RANGED} THEN {_cut('0', 'lo')} || {_ZEROS.format('lo - n')} || CASE WHEN (p > q) <> turn THEN rd ELSE d END || {_cut('hi + 1')}
    WHEN p > n THEN {_PADDED} ELSE {_INSIDE} END"""
_EDIT_CLI = f"""CASE WHEN {_RANGED} AND m <> hi - lo THEN h
    WHEN {_RANGED} AND grow THEN {_WRITTEN} || {_ZEROS.format(f'hi - length({_WRITTEN}) // 2')}
    WHEN {_RANGED} THEN {_WRITTEN}
    WHEN {_TYPED_EOF} THEN h || {_T} WHEN doc_id % 2 = 0 THEN {_OVERWRITE_AT} WHEN m = 0 THEN h ELSE {_INSERT_AT} END"""
ORACLES["edit_results"] = f"""
    SELECT path, seq, CASE WHEN error IS NULL THEN length END AS length,
           CASE WHEN error IS NULL THEN content_md5 END AS content_md5, error
    FROM ({_result(
        f"CASE WHEN {_GUI} THEN {_EDIT_GUI} ELSE {_EDIT_CLI} END",
        f"SELECT *, least(p, q) AS lo, greatest(p, q) AS hi FROM ({_WITH_PAYLOAD})",
        f", doc_id AS seq, {_EDIT_ERROR} AS error",
    )})"""
_EDITS = """
    SELECT 'd' || user_id AS path, """ + derive.EDIT_OFFSET + """ AS "offset",
           CAST(arg_max(CAST(floor(value) AS BIGINT) % 256, event_id) AS SMALLINT) AS byte
    FROM events GROUP BY ALL"""
ORACLES["last_edit_wins"] = _EDITS
_ISLANDS = f"""
    SELECT *, "offset" - row_number() OVER (PARTITION BY path ORDER BY "offset") AS island FROM ({_EDITS})"""
ORACLES["edit_islands"] = f"""
    SELECT path, stretch, island, min("offset") AS start, count(*) AS length
    FROM (SELECT *, "offset" - row_number() OVER (PARTITION BY path, stretch ORDER BY "offset") AS island
          FROM (SELECT *, "offset" // 65536 AS stretch FROM ({_EDITS})))
    GROUP BY path, stretch, island"""
_RUNS = f"""
    SELECT path, min("offset") AS start, count(*) AS length,
           string_agg(printf('%02X', byte), '' ORDER BY "offset") AS bytes_hex
    FROM ({_ISLANDS}) GROUP BY path, island"""
ORACLES["coalesce_runs"] = _RUNS
_OVERLAID = f"""
    SELECT b.path, i, coalesce(printf('%02X', e.byte), stored) AS cell, e.byte IS NOT NULL AS dirty
    FROM (SELECT path, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS stored FROM ({_BLOBS})) b
    LEFT JOIN ({_EDITS}) e ON b.path = e.path AND b.i = e."offset" """
ORACLES["apply_runs"] = f"""
    SELECT path, md5(string_agg(cell, '' ORDER BY i)) AS content_md5 FROM ({_OVERLAID}) GROUP BY path"""
ORACLES["edits_preview"] = f"""
    SELECT path, i // 16 * 16 AS row_offset, string_agg(cell, ' ' ORDER BY i) AS hex,
           coalesce(string_agg(CASE WHEN dirty THEN CAST(i % 16 AS VARCHAR) END, ' ' ORDER BY i), '') AS dirty
    FROM ({_OVERLAID}) GROUP BY path, i // 16"""
ORACLES["parse_hex_byte"] = """
    SELECT event_id, CASE WHEN digits <> '' THEN CAST('0x' || digits AS INTEGER) END AS byte
    FROM (SELECT event_id, left(regexp_replace(props, '[^0-9A-Fa-f]', '', 'g'), 2) AS digits FROM events)"""
ORACLES["parse_int_auto"] = """
    SELECT event_id,
           CASE event_id % 9 WHEN 0 THEN event_id WHEN 1 THEN -event_id WHEN 2 THEN -event_id WHEN 3 THEN event_id
                             WHEN 8 THEN event_id END AS signed,
           CASE event_id % 9 WHEN 0 THEN event_id WHEN 3 THEN event_id WHEN 8 THEN event_id END AS unsigned,
           CASE event_id % 9 WHEN 0 THEN event_id WHEN 1 THEN -event_id WHEN 2 THEN -event_id WHEN 3 THEN event_id
                             WHEN 4 THEN event_id WHEN 8 THEN event_id END AS lenient
    FROM events"""

# --- events -------------------------------------------------------------------------------

_EVENTS = f"""
    SELECT event_id AS seq, epoch_us(ts) AS ts_micros, {derive.EVENT_PATH} AS path, {derive.EVENT_KIND} AS kind,
           {derive.EVENT_DETAIL} AS kind_detail FROM events"""
_RENAMED = "(kind = 'modify' AND kind_detail IN ('name_from', 'name_to', 'name_both', 'name_any'))"
ORACLES["event_filter"] = f"SELECT seq, path, kind, kind_detail FROM ({_EVENTS}) WHERE kind = 'create' OR {_RENAMED}"
ORACLES["event_filter_coarse"] = f"""
    SELECT seq, path, kind, kind_detail FROM ({_EVENTS}) WHERE kind IN ('modify', 'remove')"""
ORACLES["recursive_flag"] = f"""
    SELECT seq, (starts_with(path, 'u1/') AND NOT contains(path, '/sub/')) OR path = 'u2/f3' AS shallow,
           starts_with(path, 'u1/') OR path = 'u2/f3' AS recursive
    FROM ({_EVENTS})"""


def _bursts(gap: int) -> str:
    return f"""
    SELECT path, min(ts_micros) AS first_micros, max(ts_micros) AS last_micros, count(*) AS events,
           arg_max(kind, (ts_micros, seq)) AS kind,
           arg_max_null(kind_detail, (ts_micros, seq)) AS kind_detail, arg_max(seq, (ts_micros, seq)) AS last_order
    FROM (SELECT *, sum(CASE WHEN pause > {gap} THEN 1 ELSE 0 END)
                     OVER (PARTITION BY path ORDER BY ts_micros, seq) AS burst
          FROM (SELECT *, ts_micros - lag(ts_micros) OVER (PARTITION BY path ORDER BY ts_micros, seq) AS pause
                FROM ({_EVENTS})))
    GROUP BY path, burst"""


ORACLES["debounce_batch"] = _bursts(registry.GAP_MICROS)
ORACLES["debounce_stream"] = _bursts(registry.GAP_MICROS)
_WATCHED = f"""
    SELECT * FROM ({_EVENTS}) WHERE kind IN ('create', 'modify')"""
ORACLES["plan_actions"] = f"""
    SELECT seq, path AS source, '/out/' || string_split(path, '/')[-1] AS destination, 'copy' AS effect FROM ({_WATCHED})"""
ORACLES["dest_collisions"] = f"""
    SELECT '/out/' || string_split(path, '/')[-1] AS destination, count(*) AS writes, count(DISTINCT path) AS sources,
           arg_max(path, (ts_micros, seq)) AS winner
    FROM ({_EVENTS}) GROUP BY 1"""
ORACLES["events_x_inventory"] = f"""
    WITH present AS (SELECT path, count(*) FILTER (kind = 'create') - count(*) FILTER (kind = 'remove') AS remaining
                     FROM ({_EVENTS}) GROUP BY path)
    SELECT seq, 'copy' AS action FROM ({_EVENTS}) WHERE path IN (SELECT path FROM present WHERE remaining > 0)
    UNION ALL
    SELECT seq, 'move' AS action FROM ({_EVENTS}) WHERE path IN (SELECT path FROM present WHERE remaining >= 0)"""
ORACLES["manifest_diff"] = """
    WITH before AS (SELECT 'd' || doc_id AS path, sha256(text) AS digest FROM documents),
    after AS (SELECT CASE WHEN lang = 'de' THEN 'archive/' ELSE '' END || 'd' || doc_id AS path,
                     sha256(CASE WHEN lang = 'es' THEN text || '!' ELSE text END) AS digest
              FROM documents WHERE source <> 'src3'
              UNION ALL SELECT 'pages/' || page_id, sha256(html) FROM pages),
    removed AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY md5(path)) AS nth
                FROM before WHERE path NOT IN (SELECT path FROM after)),
    created AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY md5(path)) AS nth
                FROM after WHERE path NOT IN (SELECT path FROM before))
    SELECT 'modify' AS kind, 'data' AS kind_detail, b.path AS path, CAST(NULL AS VARCHAR) AS from_path
    FROM before b JOIN after a ON a.path = b.path WHERE a.digest <> b.digest
    UNION ALL
    SELECT CASE WHEN c.path IS NULL THEN 'remove' WHEN r.path IS NULL THEN 'create' ELSE 'modify' END,
           CASE WHEN c.path IS NOT NULL AND r.path IS NOT NULL THEN 'name_both' END,
           coalesce(c.path, r.path), CASE WHEN c.path IS NOT NULL THEN r.path END
    FROM removed r FULL JOIN created c ON r.digest = c.digest AND r.nth = c.nth"""
ORACLES["stream_dedup"] = f"""
    SELECT DISTINCT rule_name, file, matched_text
    FROM ({_scan(f"SELECT {derive.COMMIT_FILE} AS file, {derive.PLANTED_TEXT} AS text FROM documents", "file")})"""
ORACLES["monitor_dry_run"] = f"""
    SELECT arg_max(path, (ts_micros, seq)) AS source, '/out/' || string_split(path, '/')[-1] AS destination,
           'copy' AS effect, false AS done
    FROM ({_WATCHED}) GROUP BY string_split(path, '/')[-1]"""

ORACLES["watched_folder"] = ORACLES["manifest_diff"]
ORACLES["debounce_live"] = _bursts(registry.GAP_MICROS)
ORACLES["stream_dedup_ledger"] = ORACLES["stream_dedup"]
ORACLES["scan_version_stream"] = ORACLES["scan_delta"]

_GRAPH = f"""
    c AS (SELECT doc_id, {derive.GRAPH_REPO} AS repo, {derive.COMMIT_HASH} AS hash, {derive.GRAPH_TIME} AS time FROM documents),
    edges AS (
        SELECT a.repo, a.hash AS child, b.hash AS parent, b.time AS parent_time FROM (
            SELECT repo, hash, doc_id - CASE WHEN doc_id % 11 = 3 THEN 8 ELSE 4 END AS up FROM c
            UNION SELECT repo, hash, doc_id - 20 FROM c WHERE doc_id % 7 = 0) a
        JOIN c b ON a.repo = b.repo AND a.up = b.doc_id),
    walk(repo, hash, depth, floor) AS (
        SELECT repo, hash, 0, time FROM c
        WHERE {derive.GRAPH_HEAD} OR doc_id IN (SELECT max(doc_id) FROM c GROUP BY repo)
        UNION ALL
        SELECT w.repo, e.parent, w.depth + 1, min(least(w.floor, e.parent_time))
        FROM walk w JOIN edges e ON w.repo = e.repo AND w.hash = e.child GROUP BY w.repo, e.parent, w.depth + 1),
    labels AS (SELECT repo, hash, max(depth) AS depth, min(floor) AS floor FROM walk GROUP BY repo, hash)"""
ORACLES["walk_from_heads"] = f"""
    WITH RECURSIVE {_GRAPH}
    SELECT repo, hash, row_number() OVER (PARTITION BY repo ORDER BY floor DESC, depth, time DESC, hash) AS commit_pos
    FROM labels JOIN c USING (repo, hash)"""
ORACLES["history_from_heads"] = f"""
    WITH RECURSIVE {_GRAPH}
    SELECT labels.repo AS repo, file, count(*) AS lines, count(DISTINCT l.hash) AS commits
    FROM labels JOIN ({_LOG_LINES}) l ON labels.hash = l.hash GROUP BY labels.repo, file"""

for _chunked, _name in (
    ("apply_runs_chunks", "apply_runs"), ("byte_page_chunks", "byte_page"), ("byte_range_chunks", "byte_range_cli"),
    ("lines_from_chunks", "lines_of_documents"), ("scan_strings_chunks", "scan_strings_documents"),
):
    ORACLES[_chunked] = ORACLES[_name]

_MOVED = "SELECT 'd' || doc_id || '.txt' AS path, true AS done, CAST(NULL AS VARCHAR) AS error, sha256(text) AS sha256"
ORACLES["moved_files"] = f"{_MOVED}, CAST(NULL AS VARCHAR) AS left_sha256 FROM documents"
ORACLES["replayed_batch"] = f"""
    {_MOVED}, CASE WHEN doc_id % 8 = 0 THEN sha256('somebody else''s') END AS left_sha256 FROM documents"""
ORACLES["deleted_files"] = """
    SELECT 'd' || doc_id || '.txt' AS path, CASE WHEN doc_id % 3 <> 0 THEN true END AS done, CAST(NULL AS VARCHAR) AS error,
           CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS left_sha256
    FROM documents"""
