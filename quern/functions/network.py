"""IPv6 functions over Python's ipaddress, as Arrow-batched UDFs."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def aton(text: str | None) -> bytes | None:
    try:
        return None if text is None else ipaddress.ip_address(text).packed
    except ValueError:
        return None


def ntoa(raw: bytes | None) -> str | None:
    if raw is None or len(raw) not in (4, 16):
        return None
    if len(raw) == 16 and raw[:10] == bytes(10) and raw[10:12] == b"\xff\xff":
        return "::ffff:" + str(ipaddress.IPv4Address(raw[12:]))
    return str(ipaddress.ip_address(bytes(raw)))


def is_v6(text: str | None) -> int:
    try:
        return int(text is not None and ipaddress.ip_address(text).version == 6)
    except ValueError:
        return 0


def register(spark: SparkSession) -> None:
    def over(body, kind):
        def run(x: pd.Series) -> pd.Series:
            return pd.Series([body(v) for v in x], dtype=object)

        return F.pandas_udf(run, kind)

    spark.udf.register("inet6_aton", over(aton, "binary"))
    spark.udf.register("inet6_ntoa", over(ntoa, "string"))
    spark.udf.register("is_ipv6", over(is_v6, "int"))
