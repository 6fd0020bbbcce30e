"""What trades cost: profiles with their source and their parts, and results net of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostProfile:
    """A commission a side and contract in money, slippage a side in ticks, and where the numbers come from.

    Parts may be unknown; if any is given they must add up to the commission within half a cent.
    """

    name: str
    per_side: float
    slippage_ticks: float
    source: str
    assumed: bool = True
    broker: float | None = None
    exchange: float | None = None
    clearing: float | None = None
    regulator: float | None = None

    def __post_init__(self) -> None:
        if self.per_side < 0 or self.slippage_ticks < 0:
            raise ValueError(f"{self.name}: costs are not negative")
        if not self.source.strip():
            raise ValueError(f"{self.name}: a profile names its source")
        parts = self.parts()
        if parts and abs(sum(parts.values()) - self.per_side) > 0.005:
            raise ValueError(f"{self.name}: the parts make {sum(parts.values()):.4f}, not {self.per_side:.4f}")

    def parts(self) -> dict[str, float]:
        """The parts that are known; empty if none is."""
        return {k: v for k, v in (("broker", self.broker), ("exchange", self.exchange), ("clearing", self.clearing), ("regulator", self.regulator)) if v is not None}

    @property
    def round_turn(self) -> float:
        return 2 * self.per_side

    def round_turn_points(self, tick: float, point_value: float) -> float:
        """Commission and slippage of a round turn, in points."""
        return self.round_turn / point_value + 2 * self.slippage_ticks * tick


#: A total by statement without known parts, one by assumption, and none; fixed.
PROFILES = (
    CostProfile("none", 0.0, 0.0, "no costs, for comparison", assumed=True),
    CostProfile("statement", 0.95, 1.0, "an account statement's total a round turn of 1.90; its parts are not known", assumed=False),
    CostProfile("assumed_parts", 1.25, 2.0, "an assumption by parts, not checked against a statement", broker=0.50, exchange=0.35, clearing=0.20, regulator=0.20),
)


def profile_table(spark: SparkSession, profiles=PROFILES) -> DataFrame:
    """A row a profile, with its round turn, its source, whether it is assumed and whether its parts are known."""
    rows = [(p.name, p.per_side, p.round_turn, p.slippage_ticks, p.source, p.assumed, bool(p.parts())) for p in profiles]
    return spark.createDataFrame(rows, "profile string, per_side double, round_turn double, slippage_ticks double, source string, assumed boolean, parts_known boolean")


def net_of_costs(trades: DataFrame, profiles=PROFILES, tick: float = 0.25, point_value: float = 2.0, contracts: str | None = None) -> DataFrame:
    """Each trade (``points`` a contract) under each profile: gross, commission, slippage and net in money."""
    many = F.col(contracts) if contracts else F.lit(1)
    each = F.array(*(F.struct(F.lit(p.name).alias("profile"), F.lit(p.round_turn).alias("commission"), F.lit(2 * p.slippage_ticks * tick * point_value).alias("slippage")) for p in profiles))
    rows = trades.withColumn("_p", F.explode(each)).select(*trades.columns, "_p.profile", (F.col("points") * point_value * many).alias("gross"), (F.col("_p.commission") * many).alias("commission"), (F.col("_p.slippage") * many).alias("slippage"))
    return rows.withColumn("net", F.col("gross") - F.col("commission") - F.col("slippage"))


def by_profile(costed: DataFrame, by: str) -> DataFrame:
    """What is left of the gross result under each profile, and how large the average trade must be to pay for itself."""
    sums = costed.groupBy(by, "profile").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("gross", "commission", "slippage", "net")), F.avg((F.col("net") > 0).cast("double")).alias("won"))
    return sums.withColumn("cost_a_trade", (F.col("commission") + F.col("slippage")) / F.col("n")).withColumn("kept", F.when(F.col("gross") > 0, F.col("net") / F.col("gross")))
