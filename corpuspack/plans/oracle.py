"""The registered queries again, as SQL on the given tables.

Written without regard to speed and, where it can be, in another way than the
jobs: rules are tried one by one, documents are concatenated whole, cuts are a
recursive query. Named subqueries are put together as each query needs them.
"""

from __future__ import annotations

import re

from corpuspack import fixed
from corpuspack.plans.corpora import DOCUMENT_FILES, PAGE_FILES, PAGE_PATTERNS
from corpuspack.plans.settings import (
    BLOCK_BYTES,
    EXTRA_PATTERNS,
    LIMIT_BYTES,
    MAX_SPLITS,
    OVERSIZE_BYTES,
    SMALL_BLOCK,
    SMALL_MAX_SPLITS,
    SPECIAL_ID,
)

SPACE = r" \t\n\x0B\f\r"
PUNCT = r"!-/:-@\[-`{-~"
PRETOKEN = rf"[{SPACE}{PUNCT}]|[^{SPACE}{PUNCT}]+"


def lit(text: str) -> str:
    """A SQL literal, newlines included."""
    return "'" + text.replace("'", "''") + "'"


def approx(t: str) -> str:
    units = f"regexp_extract_all({t}, '[A-Za-z0-9_]+|[^{SPACE}A-Za-z0-9_]')"
    return f"floor((len({units}) + strlen({t}) - length({t})) * 1.3::DOUBLE)::BIGINT"


def by_bytes(t: str) -> str:
    return f"strlen(replace({t}, '!', ''))::BIGINT"


def sniff(t: str) -> str:
    octets = f"regexp_extract_all(hex(encode({t})[1:1024]), '..')"
    good = "x IN ('09', '0A', '0D') OR (x >= '20' AND x <= '7E')"
    return (
        f"CASE WHEN strlen({t}) = 0 THEN false ELSE "
        f"len(list_filter({octets}, lambda x: {good}))::DOUBLE / len({octets}) < 0.85 END"
    )


def extension(p: str) -> str:
    return f"lower(regexp_extract({p}, '\\.([^.]*)$', 1))"


IMAGE_LIST = ", ".join(lit(e) for e in fixed.BINARY_EXTENSIONS)


def text_name(p: str) -> str:
    return f"{extension(p)} NOT IN ({IMAGE_LIST})"


def language(p: str) -> str:
    base = f"lower(regexp_extract({p}, '([^/]*)$', 1))"
    cases = " ".join(
        f"WHEN {lit(ext)} THEN {lit(name)}" for ext, name in fixed.LANGUAGES.items()
    )
    return (
        f"CASE WHEN {base} IN ('makefile', 'gnumakefile') THEN 'make' "
        f"WHEN NOT contains(substr({base}, 2), '.') THEN '' "
        f"ELSE CASE string_split({base}, '.')[-1] {cases} ELSE '' END END"
    )


def size_text(n: str) -> str:
    out = f"printf('%.2f B', {n}::DOUBLE)"
    for k, unit in enumerate(fixed.SIZE_UNITS[1:], 1):
        scale = 1024**k
        out = (
            f"CASE WHEN {n} >= {scale} THEN printf('%.2f {unit}', {n}::DOUBLE / {scale}) "
            f"ELSE {out} END"
        )
    return out


def ticks(t: str) -> str:
    runs = f"list_transform(regexp_extract_all({t}, '`+'), lambda x: length(x))"
    return f"coalesce(list_max({runs}), 0)"


def fence(t: str) -> str:
    return f"CASE WHEN {ticks(t)} < 3 THEN 3 ELSE {ticks(t)} + 1 END"


def compiled(pattern: str) -> str:
    """Regex text of a pattern, step by step."""
    bare = f"CASE WHEN {pattern} LIKE '!%' THEN substr({pattern}, 2) ELSE {pattern} END"
    stem = f"CASE WHEN ({bare}) LIKE '%/' THEN left({bare}, length({bare}) - 1) ELSE {bare} END"
    glob = f"CASE WHEN ({stem}) LIKE '/%' THEN substr({stem}, 2) ELSE {stem} END"
    out = rf"regexp_replace({glob}, '([.^$+()\[\]{{}}|\\])', '\\\1', 'g')"
    out = rf"regexp_replace({out}, '\*\*/?', chr(1), 'g')"
    out = f"replace(replace(replace({out}, '*', '[^/]*'), '?', '.'), chr(1), '.*')"
    return (
        f"'(?s)^' || CASE WHEN ({stem}) LIKE '/%' THEN '' ELSE '.*' END || {out} || "
        rf"CASE WHEN {pattern} LIKE '%/' THEN '(/.*)?\z' ELSE '\z' END"
    )


def entries_of(files: str) -> str:
    return f"""
    SELECT repo, path, false AS is_dir FROM {files}
    UNION ALL
    SELECT DISTINCT repo, array_to_string(string_split(path, '/')[1:i], '/'), true
    FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM {files})"""


def matched(paths: str, rules: str) -> str:
    return f"""
    SELECT p.repo, p.path, coalesce(arg_max(NOT r.negation, r.rule_ord)
             FILTER (regexp_matches(p.path, r.regex)), false) AS ignored
    FROM (SELECT DISTINCT repo, path FROM {paths}) p LEFT JOIN {rules} r ON p.repo = r.repo
    GROUP BY p.repo, p.path"""


def pruned(entries: str, verdicts: str) -> str:
    return f"""
    SELECT e.repo, e.path, e.is_dir FROM {entries} e
    WHERE NOT list_contains(string_split(e.path, '/'), '.git')
      AND NOT EXISTS (
        SELECT 1 FROM {verdicts} v WHERE v.repo = e.repo AND v.ignored
          AND (v.path = e.path OR starts_with(e.path, v.path || '/')))"""


def compiled_rules(patterns: str) -> str:
    return f"""
    SELECT repo, rule_ord,
           CASE WHEN p LIKE '%/' THEN left(p, length(p) - 1) ELSE p END AS pattern,
           negation, p LIKE '/%' AS anchored, p LIKE '%/' AS dir_only, regex
    FROM (SELECT repo, rule_ord, pattern LIKE '!%' AS negation,
                 CASE WHEN pattern LIKE '!%' THEN substr(pattern, 2) ELSE pattern END AS p,
                 {compiled('pattern')} AS regex FROM {patterns})"""


def doc_pieces(entries: str = "shown", files: str = "routed") -> str:
    """All pieces with text and counted texts; the summary is added by document."""
    path = "path"
    base = f"regexp_extract({path}, '([^/]*)$', 1)"
    label = f"CASE WHEN is_dir THEN '📁 ' ELSE '📄 ' END || {base} || CASE WHEN is_dir THEN '/' ELSE '' END || chr(10)"
    indent = (
        f"CASE WHEN depth > 0 THEN repeat('│   ', (depth - 1)::BIGINT) || '├── ' ELSE '' END"
    )
    return f"""
    SELECT repo, 1 AS section, []::VARCHAR[] AS key,
           '# Directory Documentation: ' || repo || chr(10) || chr(10) AS text,
           ['# Directory Documentation: '] AS counted FROM repos
    UNION ALL
    SELECT repo, 2, [], '## Structure' || chr(10) || chr(10) || '```' || chr(10),
           ['## Structure' || chr(10) || chr(10)] FROM repos
    UNION ALL
    SELECT repo, 3, string_split(path, '/'), {indent} || {label}, [{label}]
    FROM (SELECT *, len(string_split(path, '/')) - 1 AS depth FROM {entries})
    UNION ALL
    SELECT repo, 4, [], '```' || chr(10), [] FROM repos
    UNION ALL
    SELECT repo, 5, [], chr(10) || '## Contents' || chr(10) || chr(10),
           [chr(10) || '## Contents' || chr(10) || chr(10)] FROM repos
    UNION ALL
    SELECT repo, 6, string_split(path, '/'),
           '### 📄 ' || path || chr(10) || chr(10) || body || chr(10),
           CASE kind WHEN 'text' THEN ['### 📄 ' || path || chr(10) || chr(10), text]
             ELSE ['### 📄 ' || path || chr(10) || chr(10), '*Binary file*' || chr(10),
                   '- Size: ' || size || chr(10)] END
    FROM {files}"""


SUMMARY = lit(fixed.SUMMARY_INTRO)
NOTE = lit(fixed.SPLIT_NOTE)


def whole_document(pieces: str, split: bool, stats: str = "stats") -> str:
    note = f"{SUMMARY} || {NOTE}" if split else SUMMARY
    return f"""
    SELECT repo, 0 AS section, []::VARCHAR[] AS key,
           {note} || 'Token Size: ' || total_tokens || chr(10) || chr(10) AS text
    FROM {stats}
    UNION ALL SELECT repo, section, key, text FROM {pieces}"""


def placed(doc: str) -> str:
    return f"""
    SELECT *, row_number() OVER w - 1 AS ord,
           (sum(strlen(text)) OVER w - strlen(text))::BIGINT AS start
    FROM {doc} WINDOW w AS (PARTITION BY repo ORDER BY section, key
                            ROWS UNBOUNDED PRECEDING)"""


def cuts_of(max_splits: int) -> str:
    """Greedy cuts, one recursion step per cut."""
    L = LIMIT_BYTES
    idx = "c.pos - 1"
    return f"""
    SELECT d.repo, 0 AS n, 0::BIGINT AS cur, d.total FROM doc_totals d
    UNION ALL
    SELECT w.repo, w.n + 1,
           coalesce(
             (SELECT min(c.pos) FROM cands c WHERE c.repo = w.repo AND c.kind = 'marker'
               AND {idx} >= w.cur + {L // 2} AND {idx} < w.cur + {L}),
             (SELECT max(c.pos) FROM cands c WHERE c.repo = w.repo AND c.kind = 'break'
               AND {idx} > w.cur + {L // 2} AND {idx} <= w.cur + {L}),
             (SELECT max(c.pos) FROM cands c WHERE c.repo = w.repo
               AND {idx} > greatest(w.cur, w.cur + {L} - 200) AND {idx} <= w.cur + {L}
               AND w.cur + {L} >= 200),
             w.cur + {L}),
           w.total
    FROM {{self}} w WHERE w.cur + {L} < w.total AND w.n < {max_splits}"""


CTES: dict[str, str] = {
    "files": DOCUMENT_FILES,
    "repos": "SELECT DISTINCT repo FROM files",
    "entries": entries_of("files"),
    "rule_lines": """
        SELECT repo, i AS rule_ord, lines[i] AS line
        FROM (SELECT repo, string_split(text, chr(10)) AS lines,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
              FROM files WHERE path = '.gitignore')""",
    "patterns": f"""
        SELECT repo, rule_ord, pattern FROM (
          SELECT repo, rule_ord, regexp_replace(string_split(line, chr(13))[1],
                   '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS pattern FROM rule_lines)
        WHERE pattern <> '' AND pattern NOT LIKE '#%'""",
    "rules": compiled_rules("patterns"),
    "verdicts": matched("entries", "rules"),
    "shown": pruned("entries", "verdicts"),
    "extras": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {lit(p)})" for i, p in enumerate(EXTRA_PATTERNS, 1))
    + ") t(i, pattern)",
    "patterns_plus": """
        SELECT repo, rule_ord, pattern FROM patterns
        UNION ALL
        SELECT r.repo, coalesce(m.last, 0) + x.i, x.pattern
        FROM repos r CROSS JOIN extras x
        LEFT JOIN (SELECT repo, max(rule_ord) AS last FROM patterns GROUP BY repo) m USING (repo)""",
    "rules_plus": compiled_rules("patterns_plus"),
    "verdicts_plus": matched("entries", "rules_plus"),
    "only_extras": "SELECT r.repo, x.i AS rule_ord, x.pattern FROM repos r CROSS JOIN extras x",
    "rules_extra": compiled_rules("only_extras"),
    "verdicts_extra": matched("entries", "rules_extra"),
    "all_ignored_rules": compiled_rules("(SELECT repo, 1 AS rule_ord, '/' AS pattern FROM repos WHERE repo LIKE '%1')"),
    "all_ignored_verdicts": matched("entries", "all_ignored_rules"),
    "page_files": PAGE_FILES,
    "page_repos": "SELECT DISTINCT repo FROM page_files",
    "page_entries": entries_of("page_files"),
    "page_patterns": "SELECT r.repo, x.i AS rule_ord, x.pattern FROM page_repos r CROSS JOIN (VALUES "
    + ", ".join(f"({i}, {lit(p)})" for i, p in enumerate(PAGE_PATTERNS, 1))
    + ") x(i, pattern)",
    "page_rules": compiled_rules("page_patterns"),
    "page_verdicts": matched("page_entries", "page_rules"),
    "visible": "SELECT f.* FROM files f JOIN shown s ON f.repo = s.repo AND f.path = s.path AND NOT s.is_dir",
    "kinds": f"""
        SELECT repo, path, text, strlen(text)::BIGINT AS n_bytes, {size_text('strlen(text)')} AS size,
               CASE WHEN NOT ({text_name('path')}) OR ({sniff('text')}) THEN 'binary' ELSE 'text' END AS kind
        FROM visible""",
    "routed": f"""
        SELECT *, CASE kind WHEN 'binary' THEN '*Binary file*' || chr(10) || '- Size: ' || size || chr(10)
          ELSE repeat('`', ({fence('text')})::BIGINT) || {language('path')} || chr(10) || text ||
               CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN '' ELSE chr(10) END ||
               repeat('`', ({fence('text')})::BIGINT) || chr(10) END AS body
        FROM kinds""",
    "pieces": doc_pieces(),
    "counted_rows": "SELECT repo, section, key, unnest(counted) AS t FROM pieces",
    "stats": f"""
        SELECT repo, sum(strlen(t))::BIGINT AS total_size, sum({approx('t')})::BIGINT AS total_tokens
        FROM counted_rows GROUP BY repo""",
    "structure_pieces": "SELECT * FROM pieces WHERE section < 5",
    "structure_stats": f"""
        SELECT repo, sum({approx('t')})::BIGINT AS total_tokens
        FROM (SELECT repo, unnest(counted) AS t FROM structure_pieces) GROUP BY repo""",
    "structure_doc": whole_document("structure_pieces", False, "structure_stats"),
    "placed_structure": placed("structure_doc"),
    "doc": whole_document("pieces", False),
    "doc_split": whole_document("pieces", True),
    "placed": placed("doc"),
    "placed_split": placed("doc_split"),
    "counted_tokens": f"""
        SELECT repo, section, key, t, row_number() OVER () AS nr, regexp_extract_all(t, '{PRETOKEN}') AS toks
        FROM counted_rows""",
    "counted_dictionary": "SELECT tok, 1 AS n FROM (SELECT DISTINCT unnest(toks) AS tok FROM counted_tokens)",
    "doc_totals": "SELECT repo, sum(strlen(text))::BIGINT AS total FROM doc_split GROUP BY repo",
    "plain_totals": "SELECT repo, sum(strlen(text))::BIGINT AS total FROM doc GROUP BY repo",
    "doc_texts": "SELECT repo, string_agg(text, '' ORDER BY section, key) AS text FROM doc_split GROUP BY repo",
    "doc_lines": """
        SELECT repo, i, lines[i] AS line, total FROM (
          SELECT d.repo, string_split(d.text, chr(10)) AS lines,
                 unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS i, t.total
          FROM doc_texts d JOIN doc_totals t USING (repo))""",
    "line_pos": """
        SELECT repo, line, total, (sum(strlen(line) + 1) OVER (PARTITION BY repo ORDER BY i
                 ROWS UNBOUNDED PRECEDING) - strlen(line) - 1)::BIGINT AS pos
        FROM doc_lines""",
    "cands": """
        SELECT repo, pos, CASE
            WHEN line LIKE '### 📄%' AND pos - 1 + 9 < total THEN 'marker'
            WHEN line = '' AND pos - 1 + 2 < total THEN 'break'
            WHEN line LIKE '## %' AND pos - 1 + 5 < total THEN 'break'
            ELSE 'newline' END AS kind
        FROM line_pos WHERE pos > 0""",
    "walked": cuts_of(MAX_SPLITS).replace("{self}", "walked"),
    "walked_small": cuts_of(SMALL_MAX_SPLITS).replace("{self}", "walked_small"),
    "bounds": """
        SELECT repo, n + 1 AS part, cur AS part_start, total,
               lead(cur, 1, total) OVER (PARTITION BY repo ORDER BY n) AS part_end,
               count(*) OVER (PARTITION BY repo) AS n_parts
        FROM walked""",
    "noticed": """
        SELECT *, CASE WHEN part > 1 THEN '---' || chr(10) || '**Continued from part ' || (part - 1)
                    || '**' || chr(10) || chr(10) ELSE '' END AS prefix,
               CASE WHEN part < n_parts - 1 THEN chr(10) || chr(10) || '---' || chr(10)
                    || '**Continued in part ' || (part + 1) || '**' || chr(10) ELSE '' END AS suffix
        FROM bounds""",
    "rebuilt": """
        SELECT repo, path, CASE WHEN kind = 'binary' OR text = '' THEN ''
          WHEN text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END AS content
        FROM kinds""",
    # tokens
    "pretokens": f"""
        SELECT doc_id, pos, toks[pos] AS tok FROM (
          SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM (
            SELECT doc_id, regexp_extract_all(text, '{PRETOKEN}') AS toks FROM documents))""",
    "dictionary": "SELECT tok, count(*) AS n FROM pretokens GROUP BY tok",
    "basis": f"""
        SELECT tok, count(*) AS n FROM (
          SELECT unnest(regexp_extract_all(text, '{PRETOKEN}')) AS tok FROM benchmark)
        GROUP BY tok""",
    "vocab": """
        SELECT printf('%02X', i) AS token, i::INTEGER AS id FROM range(256) t(i)
        UNION ALL
        SELECT hex(encode(tok)), (255 + row_number() OVER (ORDER BY n DESC, tok))::INTEGER
        FROM basis WHERE strlen(tok) > 1""",
    "known": "SELECT d.tok, d.n, v.id FROM dictionary d LEFT JOIN vocab v ON v.token = hex(encode(d.tok))",
    "chunk_lists": f"""
        SELECT tok, n, CASE
          WHEN strlen(tok) <> length(tok) THEN regexp_extract_all(hex(encode(tok)), '..')
          ELSE list_transform(CASE
            WHEN length(tok) <= 4 THEN [tok]
            WHEN regexp_matches(tok, '^[0-9{PUNCT}]') THEN regexp_extract_all(tok, '.')
            WHEN length(tok) <= 8 THEN regexp_extract_all(tok, '.{{1,4}}')
            WHEN length(tok) <= 16 THEN regexp_extract_all(tok, '.{{1,3}}')
            ELSE regexp_extract_all(tok, '.{{1,2}}') END, lambda x: hex(encode(x))) END AS chunks
        FROM known WHERE id IS NULL""",
    "chunk_rows": """
        SELECT tok, chunk_pos, chunks[chunk_pos + 1] AS chunk
        FROM (SELECT tok, chunks, unnest(range(0, len(chunks))) AS chunk_pos FROM chunk_lists)""",
    "chunk_ids": "SELECT c.*, v.id FROM chunk_rows c LEFT JOIN vocab v ON v.token = c.chunk",
    "chunk_bytes": """
        SELECT tok, chunk_pos, byte_pos, substr(chunk, (2 * byte_pos + 1)::BIGINT, 2) AS b FROM (
          SELECT *, unnest(range(0, strlen(chunk) // 2)) AS byte_pos FROM chunk_ids WHERE id IS NULL)""",
    "token_units": """
        SELECT tok, 0 AS chunk_pos, 0 AS byte_pos, id FROM known WHERE id IS NOT NULL
        UNION ALL SELECT tok, chunk_pos, 0, id FROM chunk_ids WHERE id IS NOT NULL
        UNION ALL SELECT b.tok, b.chunk_pos, b.byte_pos, v.id
          FROM chunk_bytes b JOIN vocab v ON v.token = b.b""",
    "prices": "SELECT tok, count(*) AS price FROM token_units GROUP BY tok",
    "merge_rows": """
        SELECT substr(token, 1, 2) AS a, substr(token, 3) AS b, id AS rank FROM vocab WHERE length(token) = 4
        UNION ALL
        SELECT substr(token, 1, 4), substr(token, 5), id FROM vocab
        WHERE length(token) = 6 AND substr(token, 1, 4) IN (SELECT token FROM vocab WHERE length(token) = 4)""",
    "merging": """
        SELECT tok, regexp_replace(hex(encode(tok)), '(..)', '<\\1>', 'g') AS state FROM dictionary
        UNION ALL
        SELECT tok, replace(state, '<' || best.a || '><' || best.b || '>', '<' || best.a || best.b || '>')
        FROM (
          SELECT tok, state, arg_min(m, [m.rank, i]) AS best
          FROM (SELECT tok, state, p, unnest(range(1, len(p))) AS i
                FROM (SELECT tok, state, string_split(state[2:-2], '><') AS p FROM {self})) s
          JOIN merge_rows m ON m.a = p[i] AND m.b = p[i + 1]
          GROUP BY tok, state)""".replace("{self}", "merging"),
    "merged_parts": """
        SELECT tok, unnest(string_split(state[2:-2], '><')) AS part FROM (
          SELECT tok, arg_min(state, length(state)) AS state FROM merging GROUP BY tok)""",
    "merged_prices": """
        SELECT tok, sum(CASE WHEN v.id IS NOT NULL THEN 1 ELSE length(part) // 2 END) AS price
        FROM merged_parts LEFT JOIN vocab v ON v.token = part GROUP BY tok""",
    "vocab_lines": """
        SELECT token, id, to_base64(unhex(token)) AS b64,
          CASE id % 50 WHEN 7 THEN to_base64(unhex(token))
            WHEN 8 THEN to_base64(unhex(token)) || ' x' || id
            WHEN 9 THEN to_base64(unhex(token)) || ' 99999999999' || id
            WHEN 10 THEN to_base64(unhex(token)) || ' +' || id || 'z'
            WHEN 11 THEN to_base64(unhex(token)) || '  ' || id
            ELSE to_base64(unhex(token)) || ' ' || id END AS value
        FROM vocab
        UNION ALL
        SELECT hex(encode(tok)), id, to_base64(encode(tok)), to_base64(encode(tok)) || ' ' || id FROM (VALUES """
    + ", ".join(f"({lit(t)}, {i})" for t, i in fixed.SPECIAL_TOKENS.items())
    + ") s(tok, id)",
}

for _name, _of in (("known", "dictionary"), ("chunk_lists", "known"), ("chunk_rows", "chunk_lists"),
                   ("chunk_ids", "chunk_rows"), ("chunk_bytes", "chunk_ids")):
    # the same look-up for the dictionary of the texts that count
    CTES[f"counted_{_name}"] = CTES[_name].replace(f"FROM {_of}", f"FROM counted_{_of}")
CTES["counted_units"] = re.sub(r"\b(known|chunk_ids|chunk_bytes)\b", r"counted_\1", CTES["token_units"])
CTES["counted_prices"] = "SELECT tok, count(*) AS price FROM counted_units GROUP BY tok"

RECURSIVE = {"walked", "walked_small", "merging"}


def compose(query: str) -> str:
    """Prefix a query with the named subqueries it needs, directly or not."""
    needed: set[str] = set()

    def add(sql: str, inside: str = "") -> None:
        for name in CTES:
            if name != inside and name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                add(CTES[name], name)

    add(query)
    if not needed:
        return query
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    recursive = "RECURSIVE " if needed & RECURSIVE else ""
    return f"WITH {recursive}{parts}\n{query}"


def part_names(column: str) -> str:
    return f"{column} || '_documentation_part' || part || '.md'"


QUERIES: dict[str, str] = {
    "corpus_summary": """
        SELECT r.repo, coalesce(f.n_files, 0)::BIGINT AS n_files, coalesce(d.n_dirs, 0)::BIGINT AS n_dirs,
               coalesce(f.n_binary, 0)::BIGINT AS n_binary, s.total_size AS total_bytes, s.total_tokens,
               p.n_parts::BIGINT AS n_parts
        FROM repos r
        LEFT JOIN (SELECT repo, count(*) AS n_files, count(*) FILTER (kind = 'binary') AS n_binary
                   FROM kinds GROUP BY repo) f USING (repo)
        LEFT JOIN (SELECT repo, count(*) AS n_dirs FROM shown WHERE is_dir GROUP BY repo) d USING (repo)
        JOIN stats s USING (repo)
        JOIN (SELECT repo, max(part) AS n_parts FROM bounds GROUP BY repo) p USING (repo)""",
    "corpus_entries": "SELECT repo, path, is_dir, (len(string_split(path, '/')) - 1)::BIGINT AS depth FROM entries",
    "corpus_entries_pages": "SELECT repo, path, is_dir, (len(string_split(path, '/')) - 1)::BIGINT AS depth FROM page_entries",
    "scan_tree": "SELECT repo, path, is_dir, (len(string_split(path, '/')) - 1)::BIGINT AS depth FROM shown",
    "read_contents": "SELECT repo, path, n_bytes, kind FROM kinds",
    "chunked_stats": "SELECT repo, total_size, total_tokens FROM stats",
    "chunked_split_points": "SELECT repo, n::BIGINT AS split_no, cur AS cut FROM walked WHERE n > 0",
    "chunked_reconstruct": "SELECT repo, path, content FROM rebuilt",
    "load_ignore_rules": "SELECT repo, rule_ord::BIGINT AS rule_ord, pattern FROM patterns",
    "compile_rules": "SELECT repo, rule_ord::BIGINT AS rule_ord, pattern, negation, anchored, dir_only, regex FROM rules_plus",
    "match_rules": "SELECT repo, path, ignored FROM verdicts",
    "match_rules_pages": "SELECT repo, path, ignored FROM page_verdicts",
    "prune_ignored": "SELECT repo, path, is_dir FROM shown",
    "prune_ignored_pages": "SELECT repo, path, is_dir FROM (" + pruned("page_entries", "page_verdicts") + ")",
    "filter_vcs": "SELECT repo, path, is_dir FROM entries WHERE NOT list_contains(string_split(path, '/'), '.git')",
    "extra_ignores": "SELECT repo, path, is_dir FROM (" + pruned("entries", "verdicts_plus") + ")",
    "no_gitignore": "SELECT repo, path, is_dir FROM (" + pruned("entries", "verdicts_extra") + ")",
    "structure_only": f"""
        SELECT repo, (start // {SMALL_BLOCK})::BIGINT AS block, min(start)::BIGINT AS start,
               string_agg(text, '' ORDER BY start) AS text
        FROM placed_structure GROUP BY repo, start // {SMALL_BLOCK}""",
    "text_by_extension": f"SELECT repo, path, {text_name('path')} AS is_text FROM files",
    "sniff_binary": f"SELECT repo, path, {sniff('text')} AS is_binary FROM files",
    "head_of_content": "SELECT repo, path, hex(encode(text)[1:1024]) AS head FROM files",
    "route_content": "SELECT repo, path, n_bytes, kind FROM kinds",
    "doc_stats": "SELECT repo, total_size, total_tokens FROM stats",
    "doc_stats_bytes": f"""
        SELECT repo, sum(strlen(t))::BIGINT AS total_size, sum({by_bytes('t')})::BIGINT AS total_tokens
        FROM counted_rows GROUP BY repo""",
    "doc_stats_vocab": """
        SELECT c.repo, sum(strlen(c.t))::BIGINT AS total_size, sum(c.price)::BIGINT AS total_tokens
        FROM (
          SELECT repo, section, key, t, coalesce(sum(p.price), 0) AS price
          FROM (SELECT repo, section, key, t, nr, unnest(CASE WHEN len(toks) = 0 THEN [NULL] ELSE toks END) AS tok
                FROM counted_tokens) u
          LEFT JOIN counted_prices p USING (tok) GROUP BY repo, section, key, nr, t) c
        GROUP BY c.repo""",
    "entry_counts": """
        SELECT repo, count(*)::BIGINT AS n_entries, count(*) FILTER (is_dir)::BIGINT AS n_dirs
        FROM shown GROUP BY repo""",
    "corpus_status": f"""
        SELECT r.repo, count(f.path)::BIGINT AS n_found, count(k.path)::BIGINT AS n_kept,
               CASE WHEN count(k.path) > 0 THEN 'ok' WHEN count(f.path) > 0 THEN 'all_ignored'
                 ELSE 'empty' END AS status
        FROM (SELECT repo FROM repos UNION SELECT DISTINCT 'no-' || lang FROM documents) r
        LEFT JOIN entries f ON f.repo = r.repo
        LEFT JOIN ({pruned('entries', 'all_ignored_verdicts')}) k
          ON k.repo = f.repo AND k.path = f.path
        GROUP BY r.repo""",
    "assemble_document": f"""
        SELECT repo, (start // {BLOCK_BYTES})::BIGINT AS block, min(start)::BIGINT AS start,
               string_agg(text, '' ORDER BY start) AS text
        FROM placed GROUP BY repo, start // {BLOCK_BYTES}""",
    "write_pack": """
        SELECT repo, sum(strlen(text))::BIGINT AS n_bytes,
               sum(len(string_split(text, chr(10))) - 1)::BIGINT AS n_lines, any_value(l.digests) AS digests
        FROM doc JOIN (
          SELECT repo, sum(('0x' || md5(line)[1:8])::BIGINT)::BIGINT AS digests FROM (
            SELECT repo, unnest(string_split(left(text, length(text) - 1), chr(10))) AS line FROM doc)
          GROUP BY repo) l USING (repo)
        GROUP BY repo""",
    "entry_order": """
        SELECT repo, path, is_dir, row_number() OVER (PARTITION BY repo
                 ORDER BY string_split(path, '/'))::BIGINT AS position FROM shown""",
    "hier_sort": """
        SELECT repo, path, (row_number() OVER (ORDER BY repo, string_split(path, '/')) - 1)::BIGINT AS rank
        FROM page_entries""",
    "tree_lines": "SELECT repo, array_to_string(key, '/') AS path, text AS line, counted[1] AS counted FROM pieces WHERE section = 3",
    "piece_offsets": """
        SELECT repo, section::BIGINT AS section, array_to_string(key, '/') AS path, ord::BIGINT AS ord, start,
               strlen(text)::BIGINT AS n_bytes FROM placed""",
    "lint_missing_docs": r"""
        SELECT repo, path, i::BIGINT AS line_no FROM (
          SELECT *, last_value(doc IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY i
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
          FROM (
            SELECT repo, path, i, line,
              CASE WHEN regexp_matches(line, '^[ \t]*(\*|//|#)') THEN NULL
                   ELSE starts_with(ltrim(line, ' ' || chr(9)), '/**') END AS doc
            FROM (SELECT repo, path, i, lines[i] AS line FROM (
                    SELECT repo, path, string_split(text, chr(10)) AS lines,
                           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files))))
        WHERE regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_ \t\n\x0B\f\r*]*\([^;]*\)[ \t\n\x0B\f\r]*\{')
          AND NOT regexp_matches(line, '^(struct|enum|class) ')
          AND NOT coalesce(above, false)""",
    "language_of": f"SELECT repo, path, {language('path')} AS language FROM files",
    "fence_len": f"SELECT repo, path, ({fence('text')})::BIGINT AS fence FROM files",
    "human_size": f"""
        SELECT doc_id, k::BIGINT AS k, {size_text('n')} AS size FROM (
          SELECT doc_id, k, (strlen(text) << (10 * k)) // 8 + doc_id AS n
          FROM documents CROSS JOIN range(5) t(k))""",
    "render_text_section": "SELECT repo, path, body FROM routed WHERE kind = 'text'",
    "render_binary_section": "SELECT repo, path, body FROM routed WHERE kind = 'binary'",
    "render_heading": "SELECT repo, path, '### 📄 ' || path || chr(10) || chr(10) AS heading FROM files",
    "summary_header": "SELECT repo, text FROM doc WHERE section = 0",
    "default_output_name": """
        SELECT page_id, url, CASE WHEN rtrim(url, '/') = '' THEN 'directory'
          ELSE string_split(rtrim(url, '/'), '/')[-1] END || '_documentation.md' AS name FROM pages""",
    "part_file_name": r"""
        SELECT page_id, regexp_extract(url, '^(.*?)(\.[^./]*)?$', 1) || '_part' || (page_id + 1)
          || regexp_extract(url, '^(.*?)(\.[^./]*)?$', 2) AS name FROM pages""",
    "title_of": "SELECT page_id, string_split(url, '/')[-1] AS title FROM pages",
    "base64_text": """
        SELECT doc_id, to_base64(encode(text)) AS b64, md5(from_base64(to_base64(encode(text)))) AS back
        FROM documents""",
    "pretokenize": "SELECT tok AS pretoken, n::BIGINT AS n FROM dictionary",
    "special_tokens": f"""
        SELECT c.conv_id, c.turn, s.id FROM conversations c JOIN (
          SELECT text, ({SPECIAL_ID} + row_number() OVER (ORDER BY text))::BIGINT AS id
          FROM (SELECT DISTINCT arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)) s
        ON c.text = s.text""",
    "vocab_lookup": "SELECT tok AS pretoken, id::BIGINT AS id FROM known",
    "fallback_chunks": "SELECT tok AS pretoken, chunk_pos::BIGINT AS chunk_pos, chunk FROM chunk_rows",
    "byte_fallback": """
        SELECT k.tok AS pretoken, coalesce(p.price, 0)::BIGINT AS price
        FROM known k LEFT JOIN prices p USING (tok)""",
    "count_tokens_vocab": """
        SELECT p.doc_id, sum(r.price)::BIGINT AS tokens
        FROM pretokens p JOIN prices r USING (tok) GROUP BY p.doc_id""",
    "apply_merges": """
        SELECT p.doc_id, sum(r.price)::BIGINT AS tokens
        FROM pretokens p JOIN merged_prices r USING (tok) GROUP BY p.doc_id""",
    "count_tokens_approx": f"SELECT repo, path, {approx('text')} AS tokens FROM files",
    "count_tokens_bytes": f"SELECT repo, path, {by_bytes('text')} AS tokens FROM files",
    "encode_ids": """
        SELECT p.doc_id, string_agg(u.id, ',' ORDER BY p.pos, u.chunk_pos, u.byte_pos) AS ids
        FROM pretokens p JOIN token_units u USING (tok) GROUP BY p.doc_id""",
    "token_histogram": """
        SELECT u.id::BIGINT AS id, sum(d.n)::BIGINT AS n
        FROM dictionary d JOIN token_units u USING (tok) GROUP BY u.id""",
    "load_vocab": """
        SELECT token, id::BIGINT AS id, false AS is_special FROM vocab
        WHERE id % 50 NOT IN (7, 8, 9, 11)
        UNION ALL
        SELECT token, id, true FROM vocab_lines WHERE id >= 100257 AND id <= 100276
          AND token LIKE '3C7C%'""",
    "load_vocab_rejects": """
        SELECT value, CASE id % 50 WHEN 7 THEN 'malformed' WHEN 11 THEN 'malformed'
                        WHEN 8 THEN 'bad id' ELSE 'id out of range' END AS reason
        FROM vocab_lines WHERE id % 50 IN (7, 8, 9, 11) AND token NOT LIKE '3C7C%'""",
    "split_candidates": "SELECT repo, pos, kind FROM cands",
    "split_points": "SELECT repo, n::BIGINT AS split_no, cur AS cut FROM walked WHERE n > 0",
    "split_points_capped": "SELECT repo, n::BIGINT AS split_no, cur AS cut FROM walked_small WHERE n > 0",
    "continuation_notices": """
        SELECT repo, part::BIGINT AS part, n_parts::BIGINT AS n_parts, part_start, part_end, prefix, suffix
        FROM noticed""",
    "parts": f"""
        SELECT n.repo, n.part::BIGINT AS part, {part_names('n.repo')} AS file_name,
               n.part_start AS start, n.part_end AS end,
               sha256(encode(n.prefix) || encode(d.text)[n.part_start + 1:n.part_end]
                      || encode(n.suffix)) AS body_sha
        FROM noticed n JOIN doc_texts d USING (repo)""",
    "write_parts": """
        SELECT repo, part::BIGINT AS part,
               (strlen(prefix) + part_end - part_start + strlen(suffix))::BIGINT AS n_bytes
        FROM noticed""",
    "oversize_policy": f"""
        SELECT repo, total AS doc_bytes, total + 1 > {OVERSIZE_BYTES} AS oversize,
               CASE WHEN total + 1 > {OVERSIZE_BYTES} THEN 'structure_only' ELSE 'whole' END AS action
        FROM plain_totals""",
    "oversize_documents": f"""
        SELECT repo, count(*)::BIGINT AS n_pieces, sum(strlen(text))::BIGINT AS n_bytes
        FROM doc JOIN plain_totals USING (repo)
        WHERE total + 1 <= {OVERSIZE_BYTES} OR section < 5 GROUP BY repo""",
    "reconstruct": "SELECT repo, path, content FROM rebuilt",
    "reconstruct_parts": "SELECT repo, path, content FROM rebuilt",
    "write_reconstructed": """
        SELECT repo, path, strlen(content)::BIGINT AS n_bytes, md5(content) AS content_md5 FROM rebuilt""",
    "export_parts": f"""
        SELECT n.repo, n.part::BIGINT AS part, {part_names('n.repo')} AS file_name,
               (strlen(n.prefix) + n.part_end - n.part_start + strlen(n.suffix))::BIGINT AS n_bytes, false AS differs,
               md5(encode(n.prefix) || encode(d.text)[n.part_start + 1:n.part_end] || encode(n.suffix)) AS content_md5
        FROM noticed n JOIN doc_texts d USING (repo)""",
    "binary_placeholder": """
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) WHEN 1 THEN ''
          ELSE text || ' *Error' || chr(10) || text END AS content FROM documents""",
    "roundtrip_diff": """
        SELECT v.repo, v.path, CASE WHEN v.text = r.content THEN 'same' ELSE 'changed' END AS status
        FROM visible v JOIN rebuilt r USING (repo, path)""",
}


def oracle_queries() -> dict[str, str]:
    return {name: compose(sql) for name, sql in QUERIES.items()}
