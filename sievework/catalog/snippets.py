"""SQL text shared by the reference answers of several operations."""

from __future__ import annotations


def is_missing(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def is_missing_word(c: str) -> str:
    return f"({c} IS NULL OR {c} IN ('', 'nan', '<NA>', 'None'))"


def norm_key(c: str) -> str:
    return f"upper(trim({c}))"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9.\\-]', '', 'g')"


def number(c: str) -> str:
    return (f"CASE WHEN regexp_matches({digits(c)}, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') "
            f"THEN TRY_CAST({digits(c)} AS DOUBLE) END")


def clean_number(c: str) -> str:
    return f"regexp_matches({c}, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')"


def plain_number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN TRY_CAST({c} AS DOUBLE) END"


def iso_rewrite(c: str) -> str:
    t = f"trim({c})"
    month = f"cast((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', split_part({t}, ' ', 2)) + 2) // 3 AS varchar)"
    return (f"CASE WHEN regexp_matches({t}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') "
            f"THEN substr({t}, 7, 4) || '-' || substr({t}, 1, 2) || '-' || substr({t}, 4, 2) "
            f"WHEN regexp_matches({t}, '^[0-9]{{1,2}} [A-Za-z]{{3}} [0-9]{{4}}$') "
            f"THEN split_part({t}, ' ', 3) || '-' || lpad({month}, 2, '0') || '-' || lpad(split_part({t}, ' ', 1), 2, '0') "
            f"ELSE {t} END")


def iso_any(c: str) -> str:
    return f"coalesce(strftime(try_strptime({c}, ['%Y-%m-%d', '%m/%d/%Y', '%d %b %Y']), '%Y-%m-%d'), {c})"


ISO = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"
CURRENCY = r"'^\s*[\$£€]\s?[0-9,]+\.?[0-9]*\s*$'"
PERCENT = r"'^\s*[0-9]+(\.[0-9]+)?\s?%\s*$'"
COMMA_NUMBER = r"'^\s*[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?\s*$'"
DOLLAR_ONLY = r"'^\s*\$[0-9,]+\.?[0-9]*\s*$'"
PERCENT_TIGHT = r"'^\s*[0-9]+(\.[0-9]+)?%\s*$'"
PLAIN_NUMBER = r"'^\s*-?[0-9]+(\.[0-9]+)?\s*$'"
DATE_OR_TIME = r"'^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?\s*$'"

ITEM_COLUMNS = ["item_id", "price", "discount", "quantity", "ship_date", "flag"]
CUSTOMER_COLUMNS = ["customer_id", "name", "state", "signup_date", "email"]
ORDER_COLUMNS = ["order_id", "customer_id", "amount", "order_date", "status"]


def per_column(table: str, columns: list[str], **measures) -> str:
    """UNION ALL of one row per column with the given aggregates."""
    parts = []
    for i, c in enumerate(columns):
        values = ", ".join(f"{make(c)} AS {name}" for name, make in measures.items())
        parts.append(f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, {values} FROM {table}")
    return "\nUNION ALL\n".join(parts)


# Two-table repair as common table expressions over the dirty fixtures.
REPAIRED = f"""+
c_in AS (SELECT DISTINCT {norm_key('customer_id')} AS customer_id, name, state, signup_date, email
         FROM dirty_customers),
o_in AS (SELECT DISTINCT order_id, {norm_key('customer_id')} AS customer_id, amount, order_date, status
         FROM dirty_orders),
c_fixed AS (SELECT customer_id, CASE WHEN {is_missing('name')} THEN 'UNKNOWN' ELSE name END AS name,
              upper(trim(state)) AS state, {iso_rewrite('signup_date')} AS signup_date, email FROM c_in),
o_all AS (SELECT order_id, customer_id, coalesce({number('amount')}, 0.0) AS amount,
            {iso_rewrite('order_date')} AS order_date, lower(trim(status)) AS status,
            (customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM c_in WHERE customer_id IS NOT NULL))
              AS is_orphan FROM o_in)
"""


def scorecard(customers: str, orders: str, amount: str = "amount") -> str:
    """Six (dimension, good, total) rows over two tables."""
    missing_c = " + ".join(f"count(*) FILTER (WHERE NOT {is_missing(c)})" for c in ("customer_id", "name"))
    missing_o = " + ".join(f"count(*) FILTER (WHERE NOT {is_missing(c)})" for c in ("order_id", "customer_id", amount))
    noisy = "trim(customer_id) <> customer_id OR upper(customer_id) <> customer_id"
    return f"""
SELECT 'completeness' AS dimension, {missing_c} AS good, count(*) * 2 AS total FROM {customers}
UNION ALL SELECT 'completeness', {missing_o}, count(*) * 3 FROM {orders}
UNION ALL SELECT 'uniqueness', (SELECT count(*) FROM (SELECT DISTINCT * FROM {customers})), count(*) FROM {customers}
UNION ALL SELECT 'uniqueness', (SELECT count(*) FROM (SELECT DISTINCT * FROM {orders})), count(*) FROM {orders}
UNION ALL SELECT 'validity',
  count(*) FILTER (WHERE regexp_matches(trim(order_date), {ISO})) + count(*) FILTER (WHERE {clean_number(amount)}),
  count(order_date) + count({amount}) FROM {orders}
UNION ALL SELECT 'consistency', count(*) FILTER (WHERE n = 1), count(*) FROM
  (SELECT count(DISTINCT state) AS n FROM {customers} WHERE state IS NOT NULL GROUP BY lower(trim(state)))
UNION ALL SELECT 'consistency', count(*) FILTER (WHERE n = 1), count(*) FROM
  (SELECT count(DISTINCT status) AS n FROM {orders} WHERE status IS NOT NULL GROUP BY lower(trim(status)))
UNION ALL SELECT 'integrity', count(*) FILTER (WHERE {norm_key('customer_id')} IN
  (SELECT {norm_key('customer_id')} FROM {customers} WHERE customer_id IS NOT NULL)), count(customer_id) FROM {orders}
UNION ALL SELECT 'key_hygiene', count(*) FILTER (WHERE NOT ({noisy})), count(customer_id) FROM {customers}
UNION ALL SELECT 'key_hygiene', count(*) FILTER (WHERE NOT ({noisy})), count(customer_id) FROM {orders}
"""


def scorecard_wide(parts: str) -> str:
    """One row with the six scores and their mean from (dimension, good, total) rows."""
    dims = ["completeness", "uniqueness", "validity", "consistency", "integrity", "key_hygiene"]
    score = "100.0 * sum(good) FILTER (WHERE dimension = '{0}') / sum(total) FILTER (WHERE dimension = '{0}')"
    columns = ", ".join(f"CAST(round({score.format(d)}, 6) AS DOUBLE) AS {d}" for d in dims)
    mean = " + ".join(f"({score.format(d)})" for d in dims)
    return f"SELECT {columns}, CAST(round(({mean}) / 6, 6) AS DOUBLE) AS overall FROM ({parts})"


# One-table repair of the items as common table expressions: `unique_items`, then `clean_items`.
def repaired_items(table: str) -> str:
    q = plain_number("quantity")
    return f"""+
unique_items AS (SELECT DISTINCT trim(item_id) AS item_id, trim(price) AS price, trim(discount) AS discount,
                   trim(quantity) AS quantity, trim(ship_date) AS ship_date, trim(flag) AS flag FROM {table}),
flag_counts AS (SELECT lower(trim(flag)) AS norm, trim(flag) AS flag, count(*) AS n FROM {table}
                WHERE flag IS NOT NULL GROUP BY 1, 2),
flag_best AS (SELECT norm, flag AS best FROM
   (SELECT norm, flag, row_number() OVER (PARTITION BY norm ORDER BY n DESC, flag) AS rn FROM flag_counts) WHERE rn = 1),
coerced AS (SELECT item_id, {number('price')} AS price, {number('discount')} AS discount, {q} AS quantity, quantity AS quantity_text,
              {iso_any('ship_date')} AS ship_date, best AS flag
            FROM unique_items LEFT JOIN flag_best ON lower(flag) = norm),
clean_items AS (SELECT item_id, coalesce(price, (SELECT median(price) FROM coerced)) AS price,
   discount, coalesce(quantity, (SELECT median(quantity) FROM coerced)) AS quantity, ship_date,
   coalesce(flag, 'UNKNOWN') AS flag FROM coerced)
"""
