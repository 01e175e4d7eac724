"""Packets built from the ``events`` table: header fields by arithmetic, and the bytes that carry them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import hex_be

#: The same view in SQL, for comparison.
PACKETS_SQL = """
    SELECT event_id AS pkt_idx,
           epoch_us(ts) * 1000 + event_id % 1000 AS ts_ns,
           CAST(167772160 + user_id AS BIGINT) AS src_ip,
           CAST(3232235776 + (event_id * 7) % 64 AS BIGINT) AS dst_ip,
           CASE WHEN event_type = 'error' THEN 1 WHEN event_type IN ('click', 'view') THEN 6 ELSE 17 END AS ip_proto,
           CASE WHEN event_type = 'error' THEN NULL ELSE 1024 + user_id % 500 END AS sport,
           CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 5 = 0 THEN 80 WHEN event_id % 5 = 1 THEN 443
                WHEN event_id % 5 = 2 THEN 53 WHEN event_id % 5 = 3 THEN 8080 ELSE 20019 END AS dport,
           CASE WHEN event_id % 4 = 0 THEN 100 + user_id % 3 ELSE NULL END AS vlan_id,
           60 + (event_id * 131) % 1455 AS frame_len,
           LEAST(60 + (event_id * 131) % 1455, 256) AS cap_len,
           CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 89 = 0 THEN 1 ELSE 0 END AS flags,
           event_id % 3 AS src
    FROM events"""


def packets(spark: SparkSession, sf_dir: str, with_data: bool = False) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    length = 60 + (e * 131) % 1455
    df = ev.select(
        e.alias("pkt_idx"),
        (micros * 1000 + e % 1000).alias("ts_ns"),
        (167772160 + u).cast("long").alias("src_ip"),
        (3232235776 + (e * 7) % 64).cast("long").alias("dst_ip"),
        F.when(kind == "error", 1).when(kind.isin("click", "view"), 6).otherwise(17).cast("long").alias("ip_proto"),
        F.when(kind != "error", 1024 + u % 500).alias("sport"),
        F.when(kind != "error", F.when(e % 5 == 0, 80).when(e % 5 == 1, 443).when(e % 5 == 2, 53).when(e % 5 == 3, 8080).otherwise(20019)).cast("long").alias("dport"),
        F.when(e % 4 == 0, 100 + u % 3).alias("vlan_id"),
        length.alias("frame_len"),
        F.least(length, F.lit(256)).alias("cap_len"),
        F.when(e % 97 == 0, 2).when(e % 89 == 0, 1).otherwise(0).alias("flags"),
        (e % 3).alias("src"),
    )
    return with_bytes(df) if with_data else df


def with_bytes6(df: DataFrame) -> DataFrame:
    """Add ``data`` as IPv6: from 2001:db8::(user) to fd00:(index mod 7)::(last byte of the IPv4 address), otherwise as ``with_bytes`` has it."""
    head = F.concat(
        F.lit("001122334455006677889900" + "86DD" + "60000000"), hex_be(F.col("frame_len") - 54, 2), hex_be(F.when(F.col("ip_proto") == 1, 58).otherwise(F.col("ip_proto")), 1), F.lit("40"),
        F.lit("20010DB8" + "0" * 16), hex_be(F.col("src_ip") - 167772160, 4), F.lit("FD00"), hex_be(F.col("pkt_idx") % 7, 2), F.lit("0" * 16), hex_be(F.col("dst_ip") - 3232235776, 4),
        hex_be(F.coalesce("sport", F.lit(0)), 2), hex_be(F.coalesce("dport", F.lit(0)), 2),
    )
    return df.withColumn("data", F.when(F.monotonically_increasing_id() >= 0, F.unhex(F.rpad(head, (F.col("cap_len") * 2).cast("int"), F.lit("0")))))


def with_bytes(df: DataFrame) -> DataFrame:
    """Add ``data``: Ethernet, an optional VLAN tag, IPv4 and TCP, UDP or ICMP, zeros up to ``cap_len``."""
    tagged = F.col("vlan_id").isNotNull()
    net = F.when(tagged, 18).otherwise(14)
    eth = F.concat(
        F.lit("001122334455"),
        F.lit("0066"),
        hex_be(F.col("src_ip"), 4),
        F.when(tagged, F.concat(F.lit("8100"), hex_be(F.coalesce("vlan_id", F.lit(0)), 2))).otherwise(F.lit("")),
        F.lit("0800"),
    )
    ip = F.concat(
        F.lit("4500"), hex_be(F.col("frame_len") - net, 2), F.lit("0000000040"), hex_be(F.col("ip_proto"), 1), F.lit("0000"), hex_be(F.col("src_ip"), 4), hex_be(F.col("dst_ip"), 4)
    )
    ports = F.concat(hex_be(F.coalesce("sport", F.lit(0)), 2), hex_be(F.coalesce("dport", F.lit(0)), 2))
    tcp = F.concat(ports, hex_be(F.col("pkt_idx") % 4294967296, 4), F.lit("000000005010100000000000"))
    udp = F.concat(ports, hex_be(F.col("frame_len") - net - 20, 2), F.lit("0000"))
    head = F.concat(eth, ip, F.when(F.col("ip_proto") == 6, tcp).when(F.col("ip_proto") == 17, udp).otherwise(F.lit("0800000000000000")))
    data = F.unhex(F.rpad(head, (F.col("cap_len") * 2).cast("int"), F.lit("0")))
    # bytes are made once for a row, as if read from a file: an expression that isn't deterministic isn't copied into every use of the column
    return df.withColumn("data", F.when(F.monotonically_increasing_id() >= 0, data))
