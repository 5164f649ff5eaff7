"""The SQL of the queries that SQL can express, over the tables they read."""

from __future__ import annotations

#: CRC-32 in SQL: its table of 256 entries from the polynomial, and the checksum of a hexadecimal string.
CRC_TABLE = """crc_steps(i, k, x) AS (
            SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc_steps WHERE k < 8
        ), crc_table AS (SELECT list(x ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

#: Packing in blocks of BLOCK_ITEMS documents, whose open bins are packed with each other in parts of as many.
PACKING = r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n, source, coalesce(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), -1) AS cluster, row_number() OVER (PARTITION BY doc_id, text, source) AS copy FROM documents
        ), dealt AS (
            SELECT *, CAST('0x' || substr(md5(doc_id || '|' || cluster), 1, 15) AS BIGINT) % greatest(1, (count(*) OVER () + BLOCK_ITEMS - 1) // BLOCK_ITEMS) AS block FROM docs
        ), pieces AS (
            SELECT doc_id, source, cluster, copy, block, n, p AS piece, least(4096, n - 4096 * p) AS size FROM (SELECT *, unnest(range(0, greatest(1, (n + 4095) // 4096))) AS p FROM dealt)
        ), items AS (
            SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, doc_id, cluster, source, copy, piece) AS i FROM pieces WHERE size > 0
        ), walk AS (
            SELECT block, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(room BIGINT, s VARCHAR[], c BIGINT[])[]) AS bins, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS at FROM (SELECT DISTINCT block FROM items)
            UNION ALL
            SELECT block, i, CASE WHEN b > len(bins) THEN list_append(bins, {'room': 4096 - size, 's': [src], 'c': [cluster]})
                ELSE list_concat(list_append(bins[: b - 1], {'room': bins[b].room - size, 's': list_append(bins[b].s, src), 'c': list_append(bins[b].c, cluster)}), bins[b + 1 :]) END, b, CASE WHEN b > len(bins) THEN 0 ELSE 4096 - bins[b].room END
            FROM (
                SELECT t.block, t.i, t.size, coalesce(t.source, chr(1)) AS src, t.cluster, w.bins, coalesce(list_min(list_transform(
                    list_filter(range(1, len(w.bins) + 1), lambda k: w.bins[k].room >= t.size AND NOT list_contains(w.bins[k].c, t.cluster) AND len(list_filter(w.bins[k].s, lambda x: x = coalesce(t.source, chr(1)))) < 4),
                    lambda k: w.bins[k].room * 1000000 + k)) % 1000000, len(w.bins) + 1) AS b
                FROM walk w JOIN items t ON t.block = w.block AND t.i = w.i + 1
            )
        ), placed AS (
            SELECT t.doc_id, t.piece, t.size, t.source, t.cluster, t.block, w.b - 1 AS bin, w.at FROM walk w JOIN items t ON t.block = w.block AND t.i = w.i
        ), filled AS (
            SELECT block, bin, CAST(sum(size) AS BIGINT) AS words, list(coalesce(source, chr(1))) AS s, list(cluster) AS c FROM placed GROUP BY 1, 2
        ), dealt_bins AS (
            SELECT *, CAST('0x' || substr(md5(block || '|' || bin), 1, 15) AS BIGINT) % greatest(1, (count(*) OVER () + BLOCK_ITEMS - 1) // BLOCK_ITEMS) AS part FROM filled WHERE words < 3891
        ), open AS (
            SELECT *, row_number() OVER (PARTITION BY part ORDER BY words DESC, block, bin) AS i FROM dealt_bins
        ), again AS (
            SELECT part, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(room BIGINT, s VARCHAR[], c BIGINT[])[]) AS bins, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS at FROM (SELECT DISTINCT part FROM dealt_bins)
            UNION ALL
            SELECT part, i, CASE WHEN b > len(bins) THEN list_append(bins, {'room': 4096 - words, 's': s, 'c': c})
                ELSE list_concat(list_append(bins[: b - 1], {'room': bins[b].room - words, 's': list_concat(bins[b].s, s), 'c': list_concat(bins[b].c, c)}), bins[b + 1 :]) END, b, CASE WHEN b > len(bins) THEN 0 ELSE 4096 - bins[b].room END
            FROM (
                SELECT o.part, o.i, o.words, o.s, o.c, w.bins, coalesce(list_min(list_transform(
                    list_filter(range(1, len(w.bins) + 1), lambda k: w.bins[k].room >= o.words AND NOT list_has_any(w.bins[k].c, o.c)
                        AND list_max(list_transform(o.s, lambda y: len(list_filter(list_concat(w.bins[k].s, o.s), lambda x: x = y)))) <= 4),
                    lambda k: w.bins[k].room * 1000000 + k)) % 1000000, len(w.bins) + 1) AS b
                FROM again w JOIN open o ON o.part = w.part AND o.i = w.i + 1
            )
        ), moved AS (
            SELECT o.block, o.bin, first_value(o.block) OVER n AS new_block, first_value(o.bin) OVER n AS new_bin, a.at AS shift, sum(o.words) OVER (PARTITION BY a.part, a.b) AS new_words
            FROM again a JOIN open o USING (part, i) WINDOW n AS (PARTITION BY a.part, a.b ORDER BY a.i)
        )
        SELECT p.doc_id, CAST(p.piece AS INTEGER) AS piece, CAST(p.size AS BIGINT) AS n_words, p.source, p.cluster, CAST(coalesce(m.new_block, p.block) AS BIGINT) AS block, CAST(coalesce(m.new_bin, p.bin) AS BIGINT) AS bin,
            CAST(p.at + coalesce(m.shift, 0) AS BIGINT) AS bin_offset, CAST(coalesce(m.new_words, f.words) AS BIGINT) AS bin_words
        FROM placed p JOIN filled f USING (block, bin) LEFT JOIN moved m ON m.block = p.block AND m.bin = p.bin
        UNION ALL SELECT doc_id, 0, 0, source, cluster, CAST(block AS BIGINT), NULL, NULL, NULL FROM pieces WHERE size <= 0
    """

SQL: dict[str, str] = {
    "op1_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL
        ), sized AS (
            SELECT *, 15 + length(role) + length(text)
                + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) - 1 AS chars
            FROM turns
        )
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewrites_history
        FROM sized GROUP BY conv_id, alone
    """,
    "op2_histogram_sort": f"""
        WITH RECURSIVE {CRC_TABLE},
        docs AS (
            SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, coalesce(hex(encode(text)), '') AS h,
                coalesce(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), 0) AS a, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS b
            FROM documents
        ), summed AS (
            SELECT *, CAST(sum(size) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total, greatest(50000, count(*) OVER () // 1000000) AS per FROM docs
        ), cut AS (
            SELECT *, CAST(len(list_filter([total * i // 8 for i in range(1, 8)], lambda x: upto - size >= x OR (upto > x AND x - (upto - size) <= upto - x))) AS INTEGER) AS shard,
                a // (1152921504606846976 // (greatest(1, (SELECT count(*) FROM docs) // per) * 16) + 1) AS p
            FROM summed
        ), parted AS (
            SELECT *, b // (1152921504606846976 // (CASE WHEN count(*) OVER (PARTITION BY shard, p) > per THEN count(*) OVER (PARTITION BY shard, p) // per + 1 ELSE 1 END) + 1) AS q FROM cut
        )
        SELECT doc_id, size, CAST({CRC.format(h="h")} AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
            CAST(row_number() OVER (PARTITION BY shard ORDER BY p, q, a, b) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM parted, crc_table
    """,
    "op3_hilbert_neighbours": r"""
        WITH cleaned AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT mode(len(embedding)) FROM embeddings)
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), rows AS (
            SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda x, y: x + y)) AS norm FROM (SELECT DISTINCT vec_id, v FROM cleaned)
        ), scored AS (
            SELECT q.vec_id AS query_id, r.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i]), lambda x, y: x + y) / (q.norm * r.norm) AS score
            FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND NOT (q.vec_id = r.vec_id AND q.v = r.v)
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
    """,
    "op4_best_fit_packing": PACKING.replace("BLOCK_ITEMS", "4096"),
    "op7_water_filling_mix": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
        ), weighed AS (
            SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources
        ), ordered AS (
            SELECT *, CAST(sum(cap) OVER w - cap AS BIGINT) AS held, CAST(sum(weight) OVER () - (sum(weight) OVER w - weight) AS BIGINT) AS rest,
                CAST(sum(source_size) OVER () AS BIGINT) AS total
            FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
        ), leveled AS (
            SELECT min_by(CAST(total - held AS DOUBLE) / CAST(rest AS DOUBLE), held) AS level
            FROM ordered WHERE cap >= CAST(total - held AS DOUBLE) / CAST(rest AS DOUBLE) * weight
        ), targets AS (
            SELECT source, source_size, CASE WHEN cap < level * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM weighed, leveled
        ), parts AS (
            SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS whole, CAST(floor(target + 0.5) AS BIGINT) % greatest(source_size, 1) AS extra FROM targets
        ), summed AS (
            SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.extra,
                CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.size RANGE UNBOUNDED PRECEDING) AS BIGINT) AS upto,
                CAST(count(*) OVER (PARTITION BY d.source, d.u, d.size) AS BIGINT) AS tied
            FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
        )
        SELECT doc_id, size, source_size, target,
            size * whole + CASE WHEN upto <= extra THEN size WHEN upto - size * tied >= extra THEN 0 ELSE (extra - upto + size * tied) // tied END AS taken
        FROM summed
    """,
    "op8_line_spread": r"""
        WITH lines AS (
            SELECT source, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')))) AS line FROM documents
        ), boiler AS (
            SELECT line FROM lines WHERE length(line) >= 16
            GROUP BY line HAVING count(DISTINCT source) >= 8 AND count(DISTINCT text) > 1
        ), gone AS (SELECT coalesce(list(line), []) AS lines FROM boiler),
        kept AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS own, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(g.lines, trim(x, ' '))) AS rest
            FROM documents, gone g
        ), decided AS (
            SELECT *, len(list_filter(rest, lambda x: length(trim(x, ' ')) > 0)) = 0 OR len(rest) = len(own) AS whole FROM kept
        )
        SELECT doc_id, CASE WHEN whole THEN text ELSE array_to_string(rest, chr(10)) END AS text,
            CAST(coalesce(len(own), 0) AS BIGINT) AS n_lines, CAST(CASE WHEN whole THEN 0 ELSE coalesce(len(own) - len(rest), 0) END AS BIGINT) AS n_removed
        FROM decided
    """,
    "op9_ngram_forest": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, text IS NULL AS without, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingled AS (
            SELECT doc_id, without, list_sort(list_distinct(CASE WHEN len(w) = 0 OR without THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM split
        ), keyed AS (
            SELECT doc_id, without, s, CASE WHEN without THEN 'null ' || doc_id ELSE md5(array_to_string(s, chr(10))) || len(s) END AS k FROM shingled
        ), sets AS (
            SELECT k, min(doc_id) AS id, count(*) AS copies, any_value(s) AS s, any_value(len(s)) AS n FROM keyed GROUP BY k
        ), items AS (SELECT id, n, unnest(s) AS x FROM sets),
        met AS (
            SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
            FROM items a JOIN items b ON a.x = b.x AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY 1, 2
        ), half AS (SELECT a, b FROM met WHERE CAST(common AS DOUBLE) / CAST(na + nb - common AS DOUBLE) >= CAST(0.8 AS DOUBLE)),
        links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
        reach AS (SELECT id, id AS r FROM sets UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
        classes AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id),
        linked AS (SELECT a AS id, sum(copies) AS n_links, count(*) AS n_texts FROM links JOIN sets ON links.b = sets.id GROUP BY a)
        SELECT keyed.doc_id, class_id, CAST(copies - 1 + coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts
        FROM keyed JOIN sets USING (k) JOIN classes USING (id) LEFT JOIN linked USING (id)
    """,
    "op10_language_id": f"""
        WITH RECURSIVE {CRC_TABLE},
        docs AS (SELECT doc_id, text, lang, coalesce({CRC.format(h="hex(encode(CAST(doc_id AS VARCHAR)))")} % 3 = 1, true) AS held_out FROM documents, crc_table),
        tokens AS (SELECT doc_id, lang, held_out, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS w FROM docs),
        worded AS (SELECT doc_id, w, any_value(CASE WHEN NOT held_out THEN lang END) AS learned, count(*) AS c FROM tokens GROUP BY 1, 2),
        prior AS (SELECT lang, count(*) AS n FROM docs WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL GROUP BY 1),
        words AS (SELECT w FROM worded GROUP BY 1),
        parts AS (
            SELECT w, 0 AS n, w AS g FROM words UNION ALL SELECT w, 1, unnest(string_split(w, '')) FROM words
            UNION ALL SELECT w, n, substr('^' || w || '$', i, n) FROM (SELECT w, n, unnest(range(1, length(w) + 4 - n)) AS i FROM words, range(2, 6) r(n))
        ),
        by_lang AS (SELECT learned AS lang, w, sum(c) AS c FROM worded WHERE learned IS NOT NULL GROUP BY 1, 2),
        seen AS (SELECT n, g, lang, sum(c) AS c FROM by_lang JOIN parts USING (w) GROUP BY 1, 2, 3),
        grams AS (SELECT DISTINCT n, g FROM seen),
        sizes AS (SELECT n, count(*) AS v FROM grams GROUP BY 1),
        totals AS (SELECT s.n, p.lang, v, coalesce(sum(c) FILTER (WHERE seen.lang = p.lang), 0) AS t FROM sizes s CROSS JOIN prior p JOIN seen ON seen.n = s.n GROUP BY 1, 2, 3),
        logs AS (SELECT grams.n, grams.g, t.lang, ln((coalesce(c, 0) + 0.5) / (t.t + 0.5 * (t.v + 1))::DOUBLE) AS l FROM grams JOIN totals t USING (n) LEFT JOIN seen ON seen.n = grams.n AND seen.g = grams.g AND seen.lang = t.lang),
        known AS (SELECT w, n, g FROM parts JOIN grams USING (n, g)),
        level AS (SELECT w, CASE WHEN min(n) = 0 THEN 0 ELSE max(n) END AS n FROM known GROUP BY 1),
        scored AS (SELECT w, lang, avg(l) AS l FROM known JOIN level USING (w, n) JOIN logs USING (n, g) GROUP BY 1, 2),
        sums AS (SELECT doc_id, p.lang, p.n AS rows, coalesce(sum(c * l), 0) AS s, sum(c) AS words FROM worded CROSS JOIN prior p LEFT JOIN scored ON scored.w = worded.w AND scored.lang = p.lang GROUP BY 1, 2, 3),
        tops AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top, sum(words) OVER (PARTITION BY doc_id, lang) AS all_words FROM sums),
        chances AS (SELECT doc_id, lang, rows, s, exp((s - top) / sqrt(all_words)) AS chance FROM tops),
        best AS (SELECT doc_id, min_by(lang, ROW(-round(s, 9), -rows, lang)) AS lang_pred, round(max(chance) / sum(chance), 6) AS score FROM chances GROUP BY 1)
        SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0) AS score FROM docs LEFT JOIN best USING (doc_id)
    """,
    "op11_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        found AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, CAST(count(*) AS BIGINT) AS lang_count FROM found GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
        counts AS (SELECT lang, source, term, CAST(count(*) AS BIGINT) AS count FROM found SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        groups AS (SELECT lang, source, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(count) AS n FROM counts GROUP BY 1, 2) USING (lang, source) GROUP BY 1, 2),
        langs AS (SELECT lang, CAST(count(term) AS BIGINT) AS v, CAST(coalesce(sum(lang_count), 0) AS BIGINT) AS lang_n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY 1),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c.count, 0) AS count, 1 + 1000000000 * (coalesce(c.count, 0) + 1) // (n + v) AS p, 1 + 1000000000 * (lang_count + 1) // (lang_n + v) AS q
            FROM groups g JOIN langs USING (lang) JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
        ), valued AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE count > 0 AND p > q
        ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM valued)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op12_anchor_dedup": r"""
        WITH split AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        windows AS (SELECT row, p, array_to_string(w[p : p + 34], ' ') AS x FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS p FROM split)),
        twice AS (SELECT x FROM windows GROUP BY 1 HAVING count(*) > 1),
        gone AS (SELECT row, list(DISTINCT p + i) AS out FROM windows SEMI JOIN twice USING (x), range(35) r(i) GROUP BY 1),
        judged AS (SELECT doc_id, w, coalesce(out, []) AS out FROM split LEFT JOIN gone USING (row))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(out) AS BIGINT) AS n_removed,
            sha256(array_to_string(CASE WHEN len(out) = 0 THEN w WHEN len(out) = len(w) THEN [] ELSE list_filter(w, lambda x, i: NOT list_contains(out, i)) END, ' ')) AS kept_sha256
        FROM judged
    """,
}


def over(name: str, table: str) -> str:
    """The SQL of a query on documents, on another table of their columns."""
    return SQL[name].replace("documents", table)
