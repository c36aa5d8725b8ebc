"""Pieces of DuckDB SQL from the rule tables, for the oracle statements."""

from __future__ import annotations

from carbonloom import dims
from carbonloom.fixtures import INVOICE_LINES


def q(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(float(value)) + "::DOUBLE" if isinstance(value, float) else str(value)


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")" if words else "FALSE"


def case(branches: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"


def values(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows) + f") AS t({names}))"


JUNK = f"""trim(coalesce(name, '')) <> '' AND NOT {any_of('name', dims.JUNK_WORDS)} AND NOT regexp_matches(name, '{dims.JUNK_DATE}')
 AND coalesce(amount, 0) > 0 AND amount < 1e8 AND NOT (length(trim(name)) <= 2 AND amount > 1e6)"""

_CODES = sorted([(p, s, f) for s, ps, _, _, f in dims.LEDGER_RULES for p in ps], key=lambda r: -len(r[0]))
CODE_SCOPE = case([(f"starts_with(trim(tax_code), '{p}')", q(s)) for p, s, _ in _CODES], "'Scope 3'")
CODE_FACTOR = case([(f"starts_with(trim(tax_code), '{p}')", q(f)) for p, _, f in _CODES], "'scope3_default'")


def _keyword(k: int) -> str:
    default = ("Scope 3", "scope3_default")[k]
    out = []
    for scope, _, words, excluded, factor in dims.LEDGER_RULES:
        value = q((scope, factor)[k])
        out.append((any_of("name", words), case([(any_of("name", excluded), q(default))], value) if excluded else value))
    return case(out, q(default))


CLASSIFIED = f"""
 coded AS (SELECT *, {CODE_SCOPE} AS code_scope, {CODE_FACTOR} AS code_factor, {_keyword(0)} AS kw_scope, {_keyword(1)} AS kw_factor FROM kept),
 ruled AS (SELECT *, {case([
     ("coalesce(tax_code, '') <> '' AND NOT (code_scope = 'Scope 1' AND " + any_of('lower(name)', dims.EXCLUSION_WORDS) + ")", "'tax_code'"),
     ("kw_factor <> 'scope3_accommodation' AND " + any_of('name', dims.ACCOMMODATION_WORDS), "'keyword_accommodation'"),
     ("kw_factor <> 'scope3_default' OR kw_scope <> 'Scope 3'", "'keyword'"),
     (any_of('seller_name', dims.LOGISTICS_SELLERS), "'seller_keyword'")], "'default'")} AS match_type FROM coded),
 classified AS (SELECT * EXCLUDE (code_scope, code_factor, kw_scope, kw_factor),
   CASE match_type WHEN 'tax_code' THEN code_scope WHEN 'keyword' THEN kw_scope ELSE 'Scope 3' END AS scope,
   CASE match_type WHEN 'tax_code' THEN code_factor WHEN 'keyword' THEN kw_factor WHEN 'keyword_accommodation' THEN 'scope3_accommodation' WHEN 'seller_keyword' THEN 'scope3_service' ELSE 'scope3_default' END AS factor_id FROM ruled)"""

_UNIT = case([(f"trim(unit) = {q(k)}", q(v)) for k, v in dims.LEDGER_UNITS.items()], "trim(unit)")
FACTORS = values([(f, u, v) for f, _, u, v in dims.LEDGER_FACTORS], "fid, funit, fvalue")
EMITTED = f"""
 emitted AS (SELECT c.*, CASE
    WHEN factor_id = 'scope3_accommodation' AND amount > 0 THEN amount * 0.2036::DOUBLE
    WHEN factor_id = 'scope3_accommodation' AND quantity > 0 THEN quantity * 66.52::DOUBLE
    WHEN factor_id = 'scope3_accommodation' THEN 0.0
    WHEN quantity > 0 AND unit <> '' AND {_UNIT} = funit THEN quantity * fvalue
    WHEN amount <= 0 THEN 0.0 WHEN funit = 'CNY' THEN amount * fvalue ELSE amount * 0.00015::DOUBLE END AS emission_kg,
   CASE WHEN factor_id = 'scope3_accommodation' AND amount > 0 THEN 'eeio' WHEN factor_id = 'scope3_accommodation' THEN 'activity'
    WHEN quantity > 0 AND unit <> '' AND {_UNIT} = funit THEN 'activity' ELSE 'eeio' END AS method
   FROM classified c LEFT JOIN {FACTORS} f ON f.fid = c.factor_id)"""

WITH_LINES = f"WITH lines AS ({INVOICE_LINES}), kept AS (SELECT * FROM lines WHERE {JUNK})"
WITH_CLASSIFIED = WITH_LINES + "," + CLASSIFIED
WITH_EMITTED = WITH_CLASSIFIED + "," + EMITTED
PRICE = "SELECT day(ts) AS dom, avg(value) + 50 AS price_per_ton FROM events WHERE event_type = 'purchase' GROUP BY day(ts)"

#: Ratios of matching characters of pairs (a, b), as `ratios` (a, b, score): the longest common run, the first in a, then in b, of equals; then the same on both sides of it.
RATIOS = """
 met AS (SELECT a, b, i, j FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM pairs) x, LATERAL (SELECT unnest(range(1, length(x.b) + 1)) AS j) y WHERE a[i:i] = b[j:j]),
 stretch AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM met),
 runs AS (SELECT a, b, i, j, max(i) OVER (PARTITION BY a, b, i - j, g) - i + 1 AS r FROM stretch),
 parts AS (
  SELECT a, b, 1::BIGINT AS al, length(a) + 1 AS ah, 1::BIGINT AS bl, length(b) + 1 AS bh, 0::BIGINT AS m FROM pairs
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN al ELSE f.i + f.n END, CASE side WHEN 0 THEN f.i ELSE ah END, CASE side WHEN 0 THEN bl ELSE f.j + f.n END, CASE side WHEN 0 THEN f.j ELSE bh END, CASE side WHEN 0 THEN f.n ELSE 0 END
  FROM (SELECT p.a, p.b, al, ah, bl, bh, max_by({'i': i, 'j': j, 'n': least(r, ah - i, bh - j)}, least(r, ah - i, bh - j) * 1000000 - i * 1000 - j) AS f
        FROM parts p JOIN runs q ON p.a = q.a AND p.b = q.b AND q.i >= al AND q.i < ah AND q.j >= bl AND q.j < bh GROUP BY p.a, p.b, al, ah, bl, bh) w, (VALUES (0), (1)) s(side)),
 ratios AS (SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS score FROM parts GROUP BY a, b)"""
