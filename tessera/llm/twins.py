"""What DuckDB can say of the newer operators: vector codes and conversation repair."""

from __future__ import annotations


def op11_sql() -> str:
    """Five assignments of distinct parts to entries, four of them followed by floored means."""
    with_ = [
        "v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS c FROM embeddings "
        "WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0)",
        "e AS (SELECT r, p, c[p * len(c) // 4 + 1 : (p + 1) * len(c) // 4] AS part FROM v, range(4) t(p))",
        "d AS (SELECT p, part, count(*) AS n FROM e GROUP BY p, part)",
        "b0 AS (SELECT p, r - 1 AS k, part AS entry FROM e WHERE r <= 256)",
    ]
    apart = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(d.part, b.entry)])"
    for i in range(5):
        with_.append(f"x{i} AS (SELECT p, part, n, k, entry, apart FROM (SELECT d.p, d.part, d.n, b.k, b.entry, {apart} AS apart FROM d JOIN b{i} b ON d.p = b.p) QUALIFY row_number() OVER (PARTITION BY p, part ORDER BY apart, k) = 1)")
        if i < 4:
            with_.append(f"s{i} AS (SELECT p, k, j, CAST(floor(sum(n * part[j]) / sum(n)) AS BIGINT) AS m FROM x{i}, range(1, 257) t(j) WHERE j <= len(part) GROUP BY p, k, j)")
            with_.append(f"b{i+1} AS (SELECT b.p, b.k, coalesce(m.entry, b.entry) AS entry FROM b{i} b LEFT JOIN (SELECT p, k, list(m ORDER BY j) AS entry FROM s{i} GROUP BY p, k) m ON b.p = m.p AND b.k = m.k)")
    with_.append("f AS (SELECT e.r, string_agg(printf('%02x', x.k), '' ORDER BY e.p) AS code, CAST(sum(x.apart) AS BIGINT) AS error FROM e JOIN x4 x ON e.p = x.p AND e.part = x.part GROUP BY e.r)")
    with_.append("h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, k)) AS h FROM b4)")
    return "WITH " + ", ".join(with_) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM f JOIN v ON f.r = v.r CROSS JOIN h"


def op12_sql() -> str:
    """CRC-32 by its table, faults by windows, edits by recursion over the turns with the cheapest, then least, audit of each grammar state."""
    sp = r"\x20\x09-\x0D"
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    with_ = ["k0 AS (SELECT n, CAST(n AS BIGINT) AS v FROM range(256) t(n))", *[f"k{i} AS (SELECT n, {bit} AS v FROM k{i - 1})" for i in range(1, 9)]]
    with_ += [
        "a AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations)",
        "m AS (SELECT DISTINCT name FROM a)",
        "c(name, i, v) AS (SELECT name, 0, CAST(4294967295 AS BIGINT) FROM m UNION ALL SELECT c.name, c.i + 1, xor(k8.v, c.v >> 8) FROM c JOIN k8 ON k8.n = xor(c.v, CAST(ascii(substr(c.name, c.i + 1, 1)) AS BIGINT)) & 255 WHERE c.i < length(c.name))",
        "h AS (SELECT a.*, xor(c.v, 4294967295) % 20 AS deal FROM a JOIN c ON c.name = a.name AND c.i = length(a.name))",
        "d AS (SELECT conv_id, turn, CASE deal WHEN 4 THEN 'user' ELSE role END AS role, CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, id * 2 + twice AS id "
        "FROM h, (VALUES (0), (1)) t(twice) WHERE deal <> 0 AND (twice = 0 OR deal = 3))",
        f"f AS (SELECT *, row_number() OVER w AS i, CASE WHEN NOT regexp_matches(text, '[^{sp}]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) > 1 THEN 'd' "
        f"WHEN NOT regexp_matches(text, '[.!?][{sp}]*$') THEN 't' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id))",
        "n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(fault = 'b' AS INTEGER)) AS blank, sum(CAST(fault = 'd' AS INTEGER)) AS duplicate, "
        "sum(CAST(fault = 't' AS INTEGER)) AS truncated, sum(CAST(coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS INTEGER)) AS illegal FROM f GROUP BY conv_id)",
        # grammar: 0 nothing, 1 system, 2 user, 3 assistant; `nxt` is the state behind the one role that may be inserted; two insertions in a row are the most that are of use
        "g(g, nxt, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user'))",
        "ins(g, to_g, more, ops, said) AS (SELECT g, g, 0, '', '' FROM g UNION ALL SELECT g, nxt, 2, 'I', chr(10) || role || ':' FROM g UNION ALL SELECT x.g, y.nxt, 4, 'II', chr(10) || x.role || ':' || chr(10) || y.role || ':' FROM g x JOIN g y ON x.nxt = y.g)",
        "z(conv_id, i, g, cost, audit, lines) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM n UNION ALL SELECT conv_id, i, g, cost, audit, lines FROM ("
        "SELECT s.*, row_number() OVER (PARTITION BY s.conv_id, s.g ORDER BY s.cost, s.audit) AS best FROM ("
        "SELECT z.conv_id, z.i + 1 AS i, CASE op WHEN 'D' THEN ins.to_g WHEN 'R' THEN g.nxt ELSE CASE substr(f.role, 1, 1) WHEN 's' THEN 1 ELSE g.nxt END END AS g, "
        "z.cost + ins.more + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN op <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END AS cost, z.audit || ins.ops || op AS audit, "
        "z.lines || ins.said || CASE op WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || g.role || ':' || f.text ELSE chr(10) || f.role || ':' || f.text END AS lines "
        "FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i + 1 JOIN ins ON ins.g = z.g JOIN g ON g.g = ins.to_g, (VALUES ('D'), ('K'), ('R')) t(op) "
        "WHERE op = 'D' OR f.fault NOT IN ('b', 'd') AND (op = 'R' OR substr(f.role, 1, 1) = substr(g.role, 1, 1) OR substr(f.role, 1, 1) = 's' AND ins.to_g = 0)) s) WHERE best = 1)",
        "e AS (SELECT z.conv_id, z.cost + ins.more AS cost, z.audit || ins.ops AS audit, z.lines || ins.said AS lines FROM z JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND n.n = z.i JOIN ins ON ins.g = z.g WHERE ins.to_g IN (0, 3) "
        "QUALIFY row_number() OVER (PARTITION BY z.conv_id ORDER BY z.cost + ins.more, z.audit || ins.ops) = 1)",
    ]
    longs = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return (
        "WITH RECURSIVE " + ", ".join(with_) + f" SELECT o.conv_id, {longs}, coalesce(audit, '') AS audit, sha256(substr(coalesce(lines, ''), 2)) AS repaired_sha256 "
        "FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"
    )
