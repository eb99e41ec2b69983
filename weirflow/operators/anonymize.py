"""Prefix-preserving pseudonyms for IPv4 addresses.

Bit p of the pad is the first bit of the AES block made of the first p address bits and the rest of a secret pad, so
addresses that share p bits keep sharing exactly p bits. The dictionary enciphers each distinct prefix once: among
addresses in order, one needs a new block only for the prefixes that it does not share with the one before. Flows get
their pseudonyms by join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.session import freeze

ADDRESS_BITS = 32
HALF = ADDRESS_BITS // 2
FULL = 0xFFFFFFFF
IPV4_FAMILIES = (0, 2)
MAX_BROADCAST = 4_000_000  # dictionary rows of two bigints
HOT_SHARE = 2048  # an address with more than 1/2048 of all references is joined by broadcast
SALTS = 4096


def _key_halves(key: str | bytes) -> tuple[bytes, bytes]:
    raw = key.encode() if isinstance(key, str) else bytes(key)
    if len(raw) != 32:
        raise ValueError("the key must have 32 bytes")
    return raw[:16], raw[16:]


def _aes(block: Column, key: bytes) -> Column:
    """First AES block; what follows it is padding."""
    return F.substring(F.aes_encrypt(block, F.lit(key), F.lit("ECB")), 1, 16)


class _Cipher:
    """Pad bits of prefixes as Column expressions."""

    def __init__(self, spark: SparkSession, key: str | bytes):
        self.key, pad_key = _key_halves(key)
        pad = bytes(spark.range(1).select(_aes(F.lit(pad_key), self.key)).first()[0])
        self.head, self.tail = int.from_bytes(pad[:4], "big"), pad[4:]

    def bit(self, address: Column, mask: Column, fill: Column) -> Column:
        """Whether the pad bit behind the masked prefix is set."""
        start = address.bitwiseAND(mask.cast("long")).bitwiseOR(fill.cast("long"))
        block = F.concat(F.unhex(F.lpad(F.hex(start), 8, "0")), F.lit(self.tail))
        return F.hex(F.substring(_aes(block, self.key), 1, 1)) >= "80"

    def prefix(self, p: int) -> tuple[int, int]:
        """Mask of the first p bits, and what the pad puts behind them."""
        mask = FULL & ~(FULL >> p)
        return mask, self.head & ~mask & FULL

    def bit_at(self, address: Column, p: int) -> Column:
        mask, fill = self.prefix(p)
        return self.bit(address, F.lit(mask), F.lit(fill))


def pseudonym(spark: SparkSession, address: Column, key: str | bytes) -> Column:
    """Pseudonym of a 32-bit address held in a bigint, by itself: 32 blocks per row."""
    cipher = _Cipher(spark, key)
    steps = F.array(*[
        F.struct(F.lit(mask).alias("mask"), F.lit(fill).alias("fill"), F.lit(1 << (ADDRESS_BITS - 1 - p)).cast("long").alias("bit"))
        for p, (mask, fill) in enumerate(map(cipher.prefix, range(ADDRESS_BITS)))
    ])

    def add(pad_bits: Column, s: Column) -> Column:
        return pad_bits + F.when(cipher.bit(address, s["mask"], s["fill"]), s["bit"]).otherwise(F.lit(0).cast("long"))

    return F.aggregate(steps, F.lit(0).cast("long"), add).bitwiseXOR(address)


def shared_bits(a: Column, b: Column) -> Column:
    """Length of the common prefix of two different addresses."""
    return F.lit(ADDRESS_BITS) - F.length(F.bin(a.bitwiseXOR(b)))


def _pad_bits(cipher: _Cipher, addresses: DataFrame, low: int, high: int, by: list[str]) -> DataFrame:
    """`addresses` with `pad`, the pad bits `low` to `high` - 1 of distinct values, one block per distinct prefix.

    In order, an address enciphers the prefixes longer than what it shares with the one before (`fresh`); the bits of
    the others are those last enciphered. Values of a group agree in their first `low` bits.
    """
    window = Window.partitionBy(*by).orderBy("address")
    before = F.lag("address").over(window)
    rows = addresses.withColumn("fresh", F.when(before.isNull(), F.lit(low)).otherwise(
        F.greatest(shared_bits(F.col("address"), before) + 1, F.lit(low))))
    rows = rows.select("*", *[F.when(F.col("fresh") <= p, cipher.bit_at(F.col("address"), p)).alias(f"_b{p}") for p in range(low, high)])
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    held = [F.last(f"_b{p}", ignorenulls=True).over(running) for p in range(low, high)]
    pad = sum((F.when(b, F.lit(1 << (ADDRESS_BITS - 1 - p)).cast("long")).otherwise(F.lit(0).cast("long"))
               for p, b in zip(range(low, high), held)), F.lit(0).cast("long"))
    return rows.select(*addresses.columns, "fresh", pad.alias("pad"))


def pseudonyms(addresses: DataFrame, key: str | bytes) -> DataFrame:
    """Distinct `address` values with `pseudonym` and `blocks`, the number of AES blocks that each took.

    The trie of prefixes is walked in two halves: the first 16 bits over at most 2^16 values in one window, the last
    16 bits over windows of at most 2^16 addresses, one per first half.
    """
    cipher = _Cipher(addresses.sparkSession, key)
    split = addresses.withColumn("_high", F.col("address").bitwiseAND(F.lit(FULL & ~(FULL >> HALF))))
    highs = split.select(F.col("_high").alias("address")).distinct()  # at most 2^16
    first = _pad_bits(cipher, highs, 0, HALF, []).select(
        F.col("address").alias("_high"), F.col("pad").alias("_pad"), (F.lit(HALF) - F.least("fresh", F.lit(HALF))).alias("_blocks"))
    last = _pad_bits(cipher, split, HALF, ADDRESS_BITS, ["_high"])
    opens = F.row_number().over(Window.partitionBy("_high").orderBy("address")) == 1  # carries the first half's blocks
    return last.withColumn("_opens", opens).join(F.broadcast(first), "_high").select(
        *addresses.columns, F.col("address").bitwiseXOR(F.col("_pad") + F.col("pad")).alias("pseudonym"),
        (F.lit(ADDRESS_BITS) - F.col("fresh") + F.when(F.col("_opens"), F.col("_blocks")).otherwise(0)).alias("blocks"))


def _ipv4(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("af").isin(*IPV4_FAMILIES))


def addresses(flows: DataFrame) -> DataFrame:
    """`(address, uses)` of all source and destination addresses; counted map-side before the exchange."""
    return _ipv4(flows).select(F.explode(F.array("sa3", "da3")).alias("address")).groupBy("address").agg(F.count("*").alias("uses"))


def dictionary(flows: DataFrame, key: str | bytes) -> DataFrame:
    """`(address, pseudonym, uses)` of all source and destination addresses."""
    return pseudonyms(addresses(flows), key).select("address", "pseudonym", "uses")


def _replace_small(flows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    names = names.select(F.col("address").alias(column), F.col("pseudonym").alias("_new"))
    return flows.join(F.broadcast(names), column).withColumn(column, F.col("_new")).drop("_new")


def _replace_large(flows: DataFrame, column: str, names: DataFrame, uses: int) -> DataFrame:
    """Hot addresses by broadcast (at most 2 * HOT_SHARE rows); the rest by a shuffle join in which rows already done
    carry a salted key that matches nothing, so that no task receives them all."""
    hot = F.col("uses") * HOT_SHARE > uses
    top = names.filter(hot).select(F.col("address").alias("_a"), F.col("pseudonym").alias("_hot"))
    rest = names.filter(~hot).select(F.col("address").alias("_k"), F.col("pseudonym").alias("_cold"))
    salt = -1 - F.pmod(F.xxhash64(*flows.columns), F.lit(SALTS))
    out = flows.join(F.broadcast(top), F.col(column) == F.col("_a"), "left")
    out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(column)).otherwise(salt))
    out = out.join(rest, F.col("_key") == F.col("_k"), "left")
    return out.withColumn(column, F.coalesce("_hot", "_cold")).drop("_a", "_hot", "_k", "_cold", "_key")


def anonymize(flows: DataFrame, key: str | bytes, names: DataFrame | None = None,
              max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Replace `sa3` and `da3`; rows of other address families are left out."""
    names = freeze(dictionary(flows, key)) if names is None else names
    rows, uses = names.agg(F.count("*"), F.sum("uses")).first()
    out = _ipv4(flows)
    for column in ("sa3", "da3"):
        if rows <= max_broadcast:
            out = _replace_small(out, column, names)
        else:
            out = _replace_large(out, column, names, uses)
    return out.select(*flows.columns)
