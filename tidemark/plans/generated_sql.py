"""The generator's orders in SQL alone: splitmix64 in 128-bit arithmetic, one step a table expression."""

from __future__ import annotations

from tidemark.functions.generator import CENTS, LABELS, WEIGHTED, YEAR

_WRAP = "18446744073709551616::UHUGEINT"


def _mixed(name: str, columns: str) -> str:
    """name_drawn with d: the mixed z of ``name``."""
    wrap = lambda value: f"CAST(({value}) % {_WRAP} AS UBIGINT) AS z"
    steps = (wrap("z::UHUGEINT + 11400714819323198485::UHUGEINT"), wrap("xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT"), wrap("xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT"))
    out = [f"{name}{n + 1} AS (SELECT {columns}, {step} FROM {name}{n or ''})" for n, step in enumerate(steps)]
    return ", ".join([*out, f"{name}_drawn AS (SELECT {columns}, xor(z, z >> 31) AS d FROM {name}3)"])


def _rotated(value: str, k: int) -> str:
    return f"CAST(({value}::UHUGEINT * {2**k}::UHUGEINT) % {_WRAP} + {value}::UHUGEINT // {2 ** (64 - k)}::UHUGEINT AS UBIGINT)"


def _seeded(tag: int, of: str, salt: str, seed: int) -> str:
    return f"xor(xor({seed}::UBIGINT, {tag}::UBIGINT), xor({_rotated(of, 17)}, {_rotated(salt, 41)}))"


def _steps(value: str, choices) -> str:
    """CASE over the running sums of weights: (weight, result)."""
    total, edge, out = sum(w for w, _ in choices), 0, "CASE"
    for w, result in choices:
        edge += w
        out += f" WHEN {value} % {total} < {edge} THEN {result}"
    return out + " END"


def _at(seconds: str) -> str:
    return f"printf('%04d-%02d-%02d 00:00:00+00', 1970 + ({seconds}) // {YEAR}, 1 + ({seconds}) // 2592000 % 12, 1 + ({seconds}) // 86400 % 28)"


def orders(cycles: int, seed: int) -> str:
    pick = lambda v, name: _steps(v, [(w, f"'{value}'") for value, w in WEIGHTED[name]])
    cents = _steps("d5", [(w, f"{low} + CAST(d9 % {high - low + 1} AS BIGINT)") for w, low, high in CENTS])
    label = _steps("d8", [(w, str(n)) for w, n in LABELS])
    text = '{{"kind":"order","payload":%d,"schema_version":1,"tags":{{"bucket":%d,"label":"%s"}}}}'.replace("{{", "{").replace("}}", "}")
    return f"""WITH ids AS (SELECT i // 20 * 100 + i % 20 + 1 AS id FROM range({cycles * 20}) t(i)),
o AS (SELECT id, salt, {_seeded(3, 'id', 'salt', seed)} AS z FROM ids, range(2, 10) s(salt)), {_mixed('o', 'id, salt')},
w AS (SELECT id, {', '.join(f'max(CASE WHEN salt = {k} THEN d END) AS d{k}' for k in range(2, 10))} FROM o_drawn GROUP BY id),
v AS (SELECT *, (id - 1) // 100 * 100 + 1 + CAST(d7 % 5 AS BIGINT) AS customer,
  {1_609_459_200 + YEAR} - CAST(d2 % {YEAR} AS BIGINT) * CAST(d2 % {YEAR} AS BIGINT) // {YEAR} AS created FROM w),
c AS (SELECT DISTINCT customer, {_seeded(2, 'customer', '11', seed)} AS z FROM v), {_mixed('c', 'customer')},
ranks AS (SELECT r, CAST(sum(10000 // r) OVER (ORDER BY r) AS UBIGINT) AS edge FROM range(1, 65) t(r)),
tenant AS (SELECT customer, (SELECT min(r) FROM ranks x WHERE x.edge > d % (SELECT edge FROM ranks y WHERE y.r = least(64, (customer - 1) // 100 + 1))) AS rank FROM c_drawn)
SELECT id AS order_id, (rank - 1) * 100 + 1 AS tenant_id, v.customer AS customer_id, {pick('d3', 'status')} AS status, {pick('d4', 'channel')} AS channel,
  CAST({cents} AS BIGINT) AS amount_cents, {_at('created')} AS created_at, {_at('created + CAST(d6 % 86400 AS BIGINT)')} AS updated_at,
  printf('{text}', CAST(d8 % 1000 AS BIGINT), CAST(d8 % 8 AS BIGINT), repeat('x', {label})) AS attributes
FROM v JOIN tenant USING (customer)"""


def order_batches(cycles: int, seed: int, size: int) -> str:
    columns = ("order_id", "tenant_id", "customer_id", "status", "channel", "amount_cents", "created_at", "updated_at", "attributes")
    line = " || chr(9) || ".join(f"CAST({c} AS VARCHAR)" for c in columns) + " || chr(10)"
    return f"""SELECT CAST((order_id - 1) // {size} AS BIGINT) AS batch, count(*) AS rows, sha256(string_agg({line}, '' ORDER BY order_id)) AS sha256
FROM ({orders(cycles, seed)}) g GROUP BY 1"""
