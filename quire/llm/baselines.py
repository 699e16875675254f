"""SQL for what the contract fixes of operators whose other columns SQL can't express.

Matches' places come from the lengths of what lies between them and of the matches before.
"""

from __future__ import annotations

from quire.llm import pii, secrets

_EIGHT = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"


def crc32_sql(text: str) -> str:
    """CRC32 of an ASCII text, bit by bit."""
    octets = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295]::bigint[], {octets}), lambda crc, b: {_EIGHT.format('xor(crc, b)')}), 4294967295)"


CRC32 = crc32_sql("doc_id::varchar")


def spans_sql(kinds: list[tuple[str, str, int, str]]) -> str:
    """doc_id, n_ of each kind, base_sha256 of documents; kinds are (name, pattern, group, condition on match m and group g)."""
    parts = []
    for rank, (name, pattern, group, condition) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(
            f"select rid, {rank} as rank, '{name}' as kind, start, start + length(m) as stop from ("
            f"select rid, (list_sum(list_transform(pieces[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0))::bigint as start, ms[i] as m, gs[i] as g from ("
            f"select rid, ms, gs, pieces, unnest(range(1, len(ms) + 1)) as i from ("
            f"select rid, regexp_extract_all(t, '{p}') as ms, regexp_extract_all(t, '{p}', {group}) as gs, string_split_regex(t, '{p}') as pieces from d))) where {condition}"
        )
    counts = ", ".join(f"count(*) filter (kind = '{k[0]}')::bigint as n_{k[0]}" for k in kinds)
    return (
        "with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), s as (" + " union all ".join(parts) + ") "
        f"select any_value(doc_id) as doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (kind is not null), '')) as base_sha256 from d left join s using (rid) group by rid"
    )


SECRETS_SQL = spans_sql([("assign", secrets.ASSIGN, 2, "length(g) >= 6"), ("access", "AKIA[A-Z0-9]+", 0, "length(m) >= 20"), ("hex", "[0-9a-f]{24,}", 0, "true")])

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DOUBLED = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: case when k % 2 = 1 then substr({_DIGITS}, length({_DIGITS}) + 1 - k, 1)::bigint else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + substr({_DIGITS}, length({_DIGITS}) + 1 - k, 1)::bigint] end))"
PII_SQL = spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0, "len(list_filter(string_split(m, '.'), lambda z: length(ltrim(z, '0')) > 3 or coalesce(try_cast(right(z, 3) as bigint), 0) > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", 0, f"length({_DIGITS}) between 14 and 19 and {_DOUBLED} % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS}) between 10 and 15"),
    ]
)
assert pii.KINDS[:4] == ("email", "ip", "card", "phone")

WORDS_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {CRC32} % 7 = 2 as held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10)) as words from documents),
w as (select rid, held_out, unnest(words) as word from d),
c as (select word, count(*) as c from w where not held_out group by word),
t as (select sum(c) as n, count(*) as v from c)
select any_value(doc_id) as doc_id, d.held_out, count(*)::bigint as n_tokens, count(c.c)::bigint as n_known, any_value(t.n)::bigint as train_tokens, round(sum(log10((coalesce(c.c, 0) + 1)::double / (t.n + t.v + 1))), 4) as base_score
from d join w using (rid) left join c using (word) cross join t group by d.rid, d.held_out
"""
