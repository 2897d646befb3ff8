"""Common table expressions for the checking SQL.

They state the derived inputs and the expected parses straight from the base
tables, so a parser is checked against what its text was made from.
"""

from __future__ import annotations

import re

from driftmap.functions.keywords import CONFIG_WORDS, STEP_KEYWORDS
from driftmap.plans import derived


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(column: str, values: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_KW = ", ".join(f"('{step}', '{w}')" for step, ws in STEP_KEYWORDS.items() for w in ws)

CTES: dict[str, str] = {
    "kw": f"SELECT * FROM (VALUES {_KW}) t(step, word)",
    "steps": "SELECT DISTINCT step FROM kw",
    "parts": f"""
        SELECT *, p_name || '<br/> Step: ' || word || '<br/> Size: ' || p_size AS label FROM (
          SELECT p_partkey AS k, p_brand || '/' || (p_partkey // {derived.BLOCK}) AS diagram_id,
            CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no, p_name, p_type, p_size,
            list_extract([{_quoted(derived.WORDS)}], CAST(p_partkey % 8 + 1 AS INTEGER)) AS word,
            {_case("p_type", derived.SUBGRAPHS)} AS grp
          FROM part)""",
    "placed": """
        SELECT *, lead(k) OVER (PARTITION BY diagram_id ORDER BY k) AS nxt,
          row_number() OVER (PARTITION BY diagram_id ORDER BY k) = 1 AS is_first,
          row_number() OVER (PARTITION BY diagram_id, p_type ORDER BY k) = 1 AS opens
        FROM parts""",
    # Every line of every diagram, with what it should be read as.
    "raw_lines": """
        SELECT diagram_id, 0 AS a, '' AS g, 0 AS ord, 'flowchart TD' AS txt, 'type' AS role, NULL AS node_id,
          NULL AS ntype, NULL AS content, NULL AS sub, NULL AS src, NULL AS dst FROM placed WHERE is_first
        UNION ALL SELECT diagram_id, 1, '', 0, '    title(Fleet)', 'skip', NULL, NULL, NULL, NULL, NULL, NULL
          FROM placed WHERE is_first
        UNION ALL SELECT diagram_id, 1, '', 1, '    purpose[brand ' || brand_no || ']', 'metadata', NULL, NULL,
          'brand ' || brand_no, NULL, NULL, NULL FROM placed WHERE is_first
        UNION ALL SELECT diagram_id, 1, '', 2, '    %% generated', 'skip', NULL, NULL, NULL, NULL, NULL, NULL
          FROM placed WHERE is_first
        UNION ALL SELECT diagram_id, 1, '', 3, '', 'skip', NULL, NULL, NULL, NULL, NULL, NULL
          FROM placed WHERE is_first
        UNION ALL SELECT diagram_id, 2, grp, -1, '    subgraph ' || grp, 'open', NULL, NULL, NULL, grp, NULL, NULL
          FROM placed WHERE opens
        UNION ALL SELECT diagram_id, 2, grp, k,
          CASE k % 3 WHEN 0 THEN '        P' || k || '[("' || label || '")]'
            WHEN 1 THEN '        P' || k || '["' || label || '"]' ELSE '        P' || k || '(' || label || ')' END,
          'node', 'P' || k, CASE k % 3 WHEN 0 THEN 'cylinder' WHEN 1 THEN 'rect' ELSE 'rounded' END,
          label, grp, NULL, NULL FROM placed
        UNION ALL SELECT diagram_id, 2, grp, 1099511627776, '    end', 'end', NULL, NULL, NULL, NULL, NULL, NULL
          FROM placed WHERE opens
        UNION ALL SELECT diagram_id, 3, '', k, '    P' || k || '["redefined ' || k || '"]', 'node', 'P' || k, 'rect',
          'redefined ' || k, NULL, NULL, NULL FROM placed WHERE k % 50 = 0
        UNION ALL SELECT diagram_id, 4, '', 0, '    LONE["lone note<br/>a<br/>b<br/>c<br/>d"]', 'node', 'LONE', 'rect',
          'lone note<br/>a<br/>b<br/>c<br/>d', NULL, NULL, NULL FROM placed WHERE is_first AND brand_no % 6 = 0
        UNION ALL SELECT diagram_id, 5, '', 0, '    subgraph S_LARGE', 'open', NULL, NULL, NULL, 'S_LARGE', NULL, NULL
          FROM placed WHERE is_first AND brand_no % 5 = 0
        UNION ALL SELECT diagram_id, 5, '', 1, '        RE1["entered again"]', 'node', 'RE1', 'rect', 'entered again',
          'S_LARGE', NULL, NULL FROM placed WHERE is_first AND brand_no % 5 = 0
        UNION ALL SELECT diagram_id, 5, '', 2, '    end', 'end', NULL, NULL, NULL, NULL, NULL, NULL
          FROM placed WHERE is_first AND brand_no % 5 = 0
        UNION ALL SELECT diagram_id, 6, '', k, '    P' || k || ' --> P' || nxt, 'edge', NULL, NULL, NULL, NULL,
          'P' || k, 'P' || nxt FROM placed WHERE nxt IS NOT NULL
        UNION ALL SELECT diagram_id, 6, '', -1, '    Step2_Chunking --> P' || k, 'edge', NULL, NULL, NULL, NULL,
          'Step2_Chunking', 'P' || k FROM placed WHERE is_first AND brand_no % 4 = 0
        UNION ALL SELECT diagram_id, 6, '', -2, '    P' || k || ' -->|odd| P' || k, 'body', NULL, NULL, NULL, NULL,
          NULL, NULL FROM placed WHERE is_first AND brand_no % 8 = 0
        UNION ALL SELECT diagram_id, 7, '', 0, '    subgraph Broken', 'open', NULL, NULL, NULL, 'Broken', NULL, NULL
          FROM placed WHERE is_first AND brand_no = 3""",
    "dl": """
        SELECT *, CAST(row_number() OVER (PARTITION BY diagram_id ORDER BY a, g, ord) - 1 AS INTEGER) AS n
        FROM raw_lines""",
    "diags": "SELECT diagram_id, string_agg(txt, chr(10) ORDER BY n) AS code FROM dl GROUP BY diagram_id",
    "defs": "SELECT diagram_id, n, node_id, ntype, content, sub, trim(txt) AS raw_line FROM dl WHERE role = 'node'",
    "nodes": """
        SELECT diagram_id, node_id, min(n) AS pos, arg_max(ntype, n) AS type, arg_max(content, n) AS content,
          arg_max(struct_pack(s := sub), n).s AS subgraph, arg_max(raw_line, n) AS raw_line
        FROM defs GROUP BY diagram_id, node_id""",
    "edges": "SELECT diagram_id, n AS seq, src, dst FROM dl WHERE role = 'edge'",
    "ends": """
        SELECT diagram_id, src AS node_id FROM edges UNION SELECT diagram_id, dst FROM edges""",
    "opened": """
        SELECT diagram_id, sub AS subgraph, min(n) AS pos, max(n) AS last_open FROM dl WHERE role = 'open'
        GROUP BY diagram_id, sub""",
    "members": """
        SELECT d.diagram_id, d.sub AS subgraph, d.node_id, d.n AS pos FROM defs d
        JOIN opened o ON o.diagram_id = d.diagram_id AND o.subgraph = d.sub AND d.n > o.last_open""",
    "tags": """
        SELECT DISTINCT diagram_id, node_id, unnest([word, step]) AS tag FROM nodes
        JOIN kw ON contains(lower(content), word)""",
    "step_nodes": """
        SELECT t.diagram_id, t.tag AS step, t.node_id FROM tags t JOIN steps s ON s.step = t.tag
        UNION SELECT m.diagram_id, s.step, m.node_id FROM members m JOIN steps s ON contains(lower(m.subgraph), s.step)""",
    "totals": "SELECT diagram_id, count(*) AS total FROM nodes GROUP BY diagram_id",
    "hist": f"""
        SELECT p.diagram_id, p.brand_no, e.event_id, e.ts, p.k, json_extract_string(e.props, '$.k') AS value, e.user_id,
          p.diagram_id || '@' || strftime(e.ts, '%Y-%m-%d') AS change_id,
          {_case("e.event_type", derived.FIELDS)} AS field, {_case("e.event_type", derived.COMPONENTS)} AS component
        FROM events e CROSS JOIN (SELECT max(p_partkey) + 1 AS n FROM part) m JOIN parts p ON p.k = (e.event_id // 5) % m.n""",
    "ch": """
        SELECT *, coalesce(old, 'N/A') AS old_value, value AS new_value,
          CASE WHEN event_id % 3 = 0 THEN ['P' || k] WHEN event_id % 7 = 0 THEN ['lone_note', 'text_splitting']
            ELSE ['text_splitting'] END AS affected_nodes
        FROM (SELECT *, lag(value) OVER (PARTITION BY diagram_id, field ORDER BY ts, event_id) AS old FROM hist)
        WHERE old IS DISTINCT FROM value""",
    "diff_rows": """
        SELECT *, 'src/' || field || '_' || (event_id % 4) || CASE WHEN event_id % 11 = 0 THEN '.md' ELSE '.py' END AS path,
          CASE WHEN event_id % 7 = 0 THEN '"' || new_value || '"' ELSE new_value END AS shown,
          CASE WHEN event_id % 5 = 0 THEN 'load_' || (event_id % 3) END AS fn
        FROM ch""",
    "diffs": """
        SELECT change_id, diagram_id, string_agg(
            'diff --git a/' || path || ' b/' || path
            || CASE WHEN old_value <> 'N/A' THEN chr(10) || '-' || field || ' = ' || old_value ELSE '' END
            || chr(10) || '+' || field || ' = ' || shown
            || CASE WHEN fn IS NOT NULL THEN chr(10) || '+def ' || fn || '(x):' ELSE '' END,
            chr(10) ORDER BY event_id) AS diff_text
        FROM diff_rows GROUP BY change_id, diagram_id""",
    "diff_set": """
        SELECT change_id, step FROM (
          SELECT change_id, CASE WHEN field = 'chunk_size' AND (event_id % 7 <> 0 OR old_value <> 'N/A') THEN 'chunking'
            WHEN field = 'model' AND event_id % 7 = 0 THEN 'embedding'
            WHEN field = 'namespace' AND event_id % 7 = 0 THEN 'vectordb'
            WHEN field = 'bucket' AND event_id % 7 = 0 THEN 'storage' END AS step FROM ch)
        WHERE step IS NOT NULL GROUP BY change_id, step""",
    "hit1": """
        SELECT DISTINCT c.change_id, c.diagram_id, n.node_id
        FROM (SELECT change_id, diagram_id, lower(unnest(affected_nodes)) AS s FROM ch) c
        JOIN nodes n ON n.diagram_id = c.diagram_id
          AND (contains(lower(n.node_id), c.s) OR contains(c.s, lower(n.node_id)))""",
    "hit2": """
        SELECT DISTINCT c.change_id, c.diagram_id, s.node_id FROM (SELECT DISTINCT change_id, diagram_id, lower(component) AS component FROM ch) c
        JOIN kw ON kw.word = c.component OR contains(c.component, kw.step)
        JOIN step_nodes s ON s.diagram_id = c.diagram_id AND s.step = kw.step""",
    "hit3": """
        SELECT DISTINCT c.change_id, c.diagram_id, t.node_id FROM (SELECT DISTINCT change_id, diagram_id, field FROM ch) c
        JOIN tags t ON t.diagram_id = c.diagram_id AND contains(c.field, t.tag)""",
    "affected": "SELECT * FROM hit1 UNION SELECT * FROM hit2 UNION SELECT * FROM hit3",
    "raw1": """
        SELECT DISTINCT d.change_id, d.diagram_id, s.node_id
        FROM (SELECT DISTINCT change_id, diagram_id, string_split(path, '/')[-1] AS f FROM diff_rows) d
        JOIN kw ON contains(lower(d.f), kw.word) JOIN step_nodes s ON s.diagram_id = d.diagram_id AND s.step = kw.step""",
    "raw2": """
        SELECT DISTINCT d.change_id, d.diagram_id, s.node_id
        FROM (SELECT DISTINCT change_id, diagram_id, fn FROM diff_rows WHERE fn IS NOT NULL) d
        JOIN kw ON contains(lower(d.fn), kw.word) JOIN step_nodes s ON s.diagram_id = d.diagram_id AND s.step = kw.step""",
    "raw4": """
        SELECT DISTINCT c.change_id, c.diagram_id, s.node_id FROM diff_set d
        JOIN (SELECT DISTINCT change_id, diagram_id FROM ch) c ON c.change_id = d.change_id
        JOIN step_nodes s ON s.diagram_id = c.diagram_id AND s.step = d.step""",
    "raw_affected": "SELECT * FROM raw1 UNION SELECT * FROM raw2 UNION SELECT * FROM hit3 UNION SELECT * FROM raw4",
    "impacts": """
        SELECT *, CASE WHEN total = 0 THEN 'full' WHEN impact_pct = 0 THEN 'none' WHEN impact_pct < 20 THEN 'low'
          WHEN impact_pct < 50 THEN 'medium' WHEN impact_pct < 80 THEN 'high' ELSE 'full' END AS impact_level
        FROM (
          SELECT c.change_id, c.diagram_id, coalesce(a.n, 0) AS affected, coalesce(t.total, 0) AS total,
            CASE WHEN coalesce(t.total, 0) = 0 THEN 100.0 ELSE CAST(coalesce(a.n, 0) AS DOUBLE) / t.total * 100 END AS impact_pct
          FROM (SELECT DISTINCT change_id, diagram_id FROM ch) c
          LEFT JOIN (SELECT change_id, count(*) AS n FROM affected GROUP BY change_id) a ON a.change_id = c.change_id
          LEFT JOIN totals t ON t.diagram_id = c.diagram_id)""",
    # Source trees from documents.
    "file_rows": f"""
        SELECT *, CASE
            WHEN doc_id % 11 = 0 THEN list_extract(['.py', '.js', '.ts', '.java'], CAST((doc_id // 11) % 4 + 1 AS INTEGER))
            WHEN doc_id % 13 = 0 THEN ''
            ELSE list_extract([{_quoted(derived.EXTENSIONS)}], CAST(doc_id % 9 + 1 AS INTEGER)) END AS ext,
          CASE WHEN doc_id % 11 = 0 THEN 'svc' || doc_id || '/' ELSE folder END AS dir,
          CASE WHEN doc_id % 11 = 0 THEN list_extract([{_quoted(derived.STARTERS)}], CAST((doc_id // 11) % 4 + 1 AS INTEGER))
            WHEN doc_id % 13 = 0 THEN '.env' || doc_id
            ELSE 'f' || doc_id || list_extract([{_quoted(derived.EXTENSIONS)}], CAST(doc_id % 9 + 1 AS INTEGER)) END AS base,
          doc_id % 11 <> 0 AND doc_id % 8 IN (0, 1) AS hidden
        FROM (SELECT doc_id, source AS repo_id, text AS content,
          CASE WHEN doc_id % 8 < 7 THEN list_extract([{_quoted(derived.DIRECTORIES)}], CAST(doc_id % 8 + 1 AS INTEGER))
            ELSE 'pkg/m' || (doc_id % 50) || '/' END AS folder FROM documents)""",
    "files": "SELECT repo_id, dir || base AS path, dir, base, ext, hidden, content, doc_id FROM file_rows",
    # One Python source per part, and the statements it must give.
    "good_scripts": """
        SELECT *, diagram_id AS repo_id, 'src/p' || k || '.py' AS path,
          'bucket, label, ''' || p_name || ''', ''0123456789012345678901234567890123456789''' AS up_args,
          k || ', ''' || p_name || ''', ''0123456789012345678901234567890123456789''' AS pool_args
        FROM parts WHERE k % 97 <> 5""",
    "stmts": """
        SELECT repo_id, path, s.seq, s.line, s.indent, s.kind, s.text FROM (
          SELECT repo_id, path, unnest([
            {'seq': 0, 'line': 4, 'indent': 0, 'kind': 'CONFIG', 'text': 'CONFIG: bucket = os.getenv(''BUCKET_' || k || ''')'},
            {'seq': 1, 'line': 5, 'indent': 0, 'kind': 'SILENT', 'text': NULL},
            {'seq': 2, 'line': 7, 'indent': 0, 'kind': 'CONFIG', 'text': 'CONFIG: splitter = Splitter(chunk_size=' || p_size || ', chunk_overlap=2)'},
            {'seq': 3, 'line': 9, 'indent': 0, 'kind': 'DATA_STRUCT', 'text': 'DATA_STRUCT: meta = Keys[''type'', ''size'']'},
            {'seq': 4, 'line': 10, 'indent': 0, 'kind': 'CONSTANT', 'text': 'CONSTANT: label = "' || p_name || '"'},
            {'seq': 5, 'line': 11, 'indent': 0, 'kind': 'IF CHECK', 'text': 'IF CHECK: limit > 10'},
            {'seq': 6, 'line': 12, 'indent': 1, 'kind': 'LOG_EVENT', 'text': '  LOG_EVENT: "part ' || k || ' ready"'},
            {'seq': 7, 'line': 13, 'indent': 1, 'kind': 'ACTION', 'text': '  ACTION: upload(' || up_args || ')'},
            {'seq': 8, 'line': 14, 'indent': 0, 'kind': 'DEF FUNCTION', 'text': 'DEF FUNCTION run:'},
            {'seq': 9, 'line': 16, 'indent': 1, 'kind': 'ACTION', 'text': '  ACTION: helper(x)'},
            {'seq': 10, 'line': 17, 'indent': 0, 'kind': 'ASSIGN', 'text': 'ASSIGN: pool = CALL Pool(' || pool_args || ')'},
            {'seq': 11, 'line': 18, 'indent': 0, 'kind': 'SILENT', 'text': NULL}
          ]) AS s FROM good_scripts)""",
    "noted": """
        SELECT repo_id, path, s.line, s.text, s.type FROM (
          SELECT repo_id, path, unnest([
            {'line': 1, 'text': 'STEP 1: load ' || p_name, 'type': 'step_marker'},
            {'line': 3, 'text': '===== ' || p_type || ' =====', 'type': 'section_header'},
            {'line': 6, 'text': 'keeps ' || p_name || ' sizes', 'type': 'explanation'},
            {'line': 8, 'text': 'TODO tune ' || k, 'type': 'todo'},
            {'line': 10, 'text': 'tail note ' || k, 'type': 'explanation'},
            {'line': 15, 'text': 'long: ' || repeat('why ', 30) || p_name, 'type': 'docstring'}
          ]) AS s FROM good_scripts)""",
    # seq of a statement, the line of the comment it takes.
    "takes": "SELECT * FROM (VALUES (0, 3), (2, 6), (4, 10), (9, 15), (10, 15)) t(seq, cline)",
    "pieces": """
        SELECT repo_id, path, seq, 99 AS ord, text FROM stmts WHERE text IS NOT NULL
        UNION ALL SELECT n.repo_id, n.path, t.seq, n.line, CASE n.type
            WHEN 'section_header' THEN chr(10) || repeat('=', 70) || chr(10) || n.text || chr(10) || repeat('=', 70)
            WHEN 'step_marker' THEN chr(10) || '>>> ' || n.text
            WHEN 'docstring' THEN '  ## ' || n.text
            ELSE '  # ' || n.text END
          FROM noted n JOIN takes t ON t.cline = n.line""",
    "skeletons": """
        SELECT repo_id, path, string_agg(text, chr(10) ORDER BY seq, ord) AS skeleton FROM pieces GROUP BY repo_id, path""",
    # Documents with headings, and their parts and chunks.
    "headed": """
        SELECT doc_id, 'T' || doc_id AS title, lang, source, '# T' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0
          THEN text || chr(10) || '## S' || doc_id || chr(10) || '### kept inside' || chr(10) || text ELSE text END AS page_content
        FROM documents""",
    "heading_lines": """
        SELECT doc_id, title, lang, source, i, line,
          sum(CASE WHEN regexp_matches(line, '^##?( |$)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part
        FROM (SELECT doc_id, title, lang, source, generate_subscripts(string_split(page_content, chr(10)), 1) AS i,
          unnest(string_split(page_content, chr(10))) AS line FROM headed)""",
    "sections": """
        SELECT doc_id, title, lang, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section, section_text
        FROM (SELECT doc_id, title, lang, source, part,
            regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS section_text
          FROM heading_lines GROUP BY doc_id, title, lang, source, part) WHERE section_text <> ''""",
    "worded": """
        SELECT *, list_filter(regexp_split_to_array(section_text, '\\s+'), lambda w: w <> '') AS words FROM sections""",
    "chunks": """
        SELECT doc_id, title, lang, source, section, CAST((s - 1) // 180 AS INTEGER) AS chunk_no,
          array_to_string(list_slice(words, s, s + 199), ' ') AS content
        FROM (SELECT *, unnest(range(1, greatest(len(words) - 20 - 1, 0) + 2, 180)) AS s FROM worded WHERE len(words) > 0)""",
    "kept": """
        SELECT doc_id, title, lang, source, section, chunk_no, '# ' || title || chr(10) || chr(10) || content AS content
        FROM chunks WHERE length(content) > 10 AND len(list_distinct(string_split(content, ''))) > 2""",
}

CONFIG_PATTERN = "|".join(CONFIG_WORDS)


def sql(body: str) -> str:
    """``body`` with the common table expressions it needs, directly or through others."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(definition)
    head = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed)
    return f"WITH {head}\n{body.strip()}" if head else body.strip()
