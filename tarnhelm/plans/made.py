"""Text made from table keys by one SQL expression that both engines evaluate alike.

The text tables hold few identifiers of most kinds, so these mix valid and corrupted ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnhelm.plans.registry import spread, table

#: (doc_id, text) from ``customer``: one kind of identifier for each remainder of the key.
PII_TEXT = """
SELECT CAST(c_custkey AS BIGINT) AS doc_id,
  CASE CAST(c_custkey % 10 AS INT)
  WHEN 0 THEN concat('Id ', lpad(CAST(c_custkey * 7 % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 50 AS STRING), 2, '0'), '-',
    lpad(CAST(c_custkey * 13 % 10000 AS STRING), 4, '0'), ' and 666-12-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '.')
  WHEN 1 THEN concat('Masked XXX-XX-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' or xx XX ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ' ***-**-1234')
  WHEN 2 THEN concat('EIN ', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey * 31 AS STRING), 7, '0'), ', not 1', '23-1234567 nor 12-34567890')
  WHEN 3 THEN concat('Lives at ', CAST(c_custkey AS STRING), ' Old ', c_mktsegment, ' Street, then 12 Elm ave')
  WHEN 4 THEN concat('Go to Apt ', CAST(c_custkey AS STRING), 'B or suite #', CAST(c_custkey % 77 AS STRING), ' by UNITED UNIT')
  WHEN 5 THEN concat('To ', c_mktsegment, ', NY ', lpad(CAST(c_custkey * 11 % 100000 AS STRING), 5, '0'), ' and ST PAUL MN 55', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-1234; ZZ 12345')
  WHEN 6 THEN concat('IBAN DE', lpad(CAST((98 - (c_custkey * 1000000 + 131400) % 97 + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) AS STRING), 2, '0'),
    lpad(CAST(c_custkey AS STRING), 18, '0'), '; XX12', lpad(CAST(c_custkey AS STRING), 14, '0'))
  WHEN 7 THEN concat('Routing number: ', substr(lpad(CAST(c_custkey AS STRING), 9, '0'), 8, 1), '00', substr(lpad(CAST(c_custkey AS STRING), 9, '0'), 7, 1), '0000',
    CAST((10 - (3 * CAST(substr(lpad(CAST(c_custkey AS STRING), 9, '0'), 8, 1) AS INT) + 3 * CAST(substr(lpad(CAST(c_custkey AS STRING), 9, '0'), 7, 1) AS INT)) % 10) % 10 AS STRING),
    '; routing no. 0', substr(lpad(CAST(c_custkey AS STRING), 9, '0'), 8, 1), '100002', CAST(c_custkey % 7 AS STRING))
  WHEN 8 THEN concat('acct #', lpad(CAST(c_custkey AS STRING), 6, '0'), ' 99; Account number: 12-34 ', CAST(c_custkey AS STRING), ' and account ', CAST(c_custkey * 0 AS STRING))
  ELSE concat('Call (212) 555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' or +44 20 7946 ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ', mail u', CAST(c_custkey AS STRING), '@ex.org, card 4111 1111 1111 111', CAST(c_custkey % 3 AS STRING))
  END AS text
FROM customer
"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def made(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A made table; ``names`` are the tables it reads."""
    views(spark, sf_dir, *names)
    return spark.sql(sql)


def pii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(made(spark, sf_dir, PII_TEXT, "customer"))
