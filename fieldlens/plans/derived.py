"""The five input tables and the small ones, derived from the given parquet files.

Cases are regions, wells suppliers, completions line numbers; every lineitem row
is one production row, so the fact tables grow with the data. Rates are whole or
quarter steps, which keeps sums of doubles exact in any order.

Built-in edge cases: production without a completion (completion 7 of every fifth
well), NULL compartment (completion 6), NULL gas rate (completion 5, flag N), other NULL
rates (quantities 50, 49 and 48 with flag R), month 13 (quantity 47 of completion 2), NULL
net pay and depth, equal depths in a well, wells that only inject, wells that change status
in 1998, cases without a backtest, modelled months that begin later than the measured ones and go on
after them, manifests that are cut short or list nothing.
"""

from functools import cached_property

from pyspark.sql import functions as F

from fieldlens.functions.measures import month_date
from fieldlens.sources.schema import PERCENTILES

# Fixed values.
SOURCES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "lineitem": "l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING, o_orderstatus STRING, "
    "o_orderdate TIMESTAMP_NTZ",
}
COMPLETIONS_PER_WELL = 7
MODEL_DELAY = 3  # months
BAND_FACTORS = dict(zip(PERCENTILES, (0.5, 0.75, 1.0, 1.25, 1.5)))


def _well_name(key):
    return F.concat(F.lit("W"), F.col(key).cast("string"))


class DerivedTables:
    """Offers the attributes of `Tables`, each built when first asked for."""

    def __init__(self, spark, folder):
        self.spark = spark
        self._folder = folder
        self._sources = {}

    def _read(self, name):
        if name not in self._sources:
            reader = self.spark.read.schema(SOURCES[name])
            self._sources[name] = reader.parquet(f"{self._folder}/{name}.parquet")
        return self._sources[name]

    def _with_case(self, rows, supplier_key):
        """Rows of a table that refers to suppliers, with well and case."""
        return (
            rows.join(self._read("supplier"), F.col(supplier_key) == F.col("s_suppkey"))
            .join(self._read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )

    @cached_property
    def fit_info(self):
        backtest = F.col("r_regionkey") % 2 == 0
        return self._read("region").select(
            F.col("r_name").alias("casename"),
            F.lit("1995-01-01").cast("date").alias("FitStartDate"),
            F.lit("2001-12-01").cast("date").alias("FitEndDate"),
            backtest.alias("IsBacktest"),
            F.when(backtest, F.lit("2000-01-01").cast("date")).alias("BacktestEndDate"),
            F.lit(1.0).alias("Dt"),
        )

    @cached_property
    def fit_runs(self):
        """Case information with one case per order, some of unknown kind."""
        start = F.col("o_orderdate").cast("date")
        status = F.col("o_orderstatus")
        backtest = F.when(status == "F", True).when(status == "O", False)
        return self._read("orders").select(
            F.concat(F.lit("RUN"), F.col("o_orderkey").cast("string")).alias("casename"),
            start.alias("FitStartDate"),
            F.date_add(start, 365).alias("FitEndDate"),
            backtest.alias("IsBacktest"),
            F.when(backtest, F.date_add(start, 270)).alias("BacktestEndDate"),
            F.lit(1.0).alias("Dt"),
        )

    @cached_property
    def completiondata(self):
        wells = (
            self._read("supplier")
            .join(self._read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("casename"), F.col("s_suppkey").alias("wk"), "s_name")
        )
        numbers = F.sequence(F.lit(1), F.lit(COMPLETIONS_PER_WELL))
        wk, ln = F.col("wk"), F.col("ln")
        rows = wells.withColumn("ln", F.explode(numbers)).filter(~((ln == 7) & (wk % 5 == 0)))

        def coded(prefix, number):
            return F.concat(F.lit(prefix), number.cast("string"))

        return rows.select(
            "casename",
            _well_name("wk").alias("WellAPI"),
            F.col("s_name").alias("WellName"),
            ln.cast("string").alias("CompSubId"),
            coded("RES_", ln % 4).alias("Reservoir"),
            coded("FB_", wk % 3).alias("FaultBlock"),
            F.when(ln != 6, coded("CMP_", (wk + ln) % 2)).alias("Compartment"),
            F.when(wk % 4 == 0, "injector").otherwise("producer").alias("Type"),
            (F.lit(4.0) + wk * 0.125 + ln * 0.25).alias("Latitude"),
            (F.lit(-73.0) + wk * 0.25 - ln * 0.125).alias("Longitude"),
            (500000 + wk * 100 + ln).cast("double").alias("X"),
            (900000 + wk * 50 - ln).cast("double").alias("Y"),
            # Completions 4 and 5 of every third well lie at one depth.
            F.when((ln != 2) | (wk % 6 != 0), (8000 - F.when((ln == 5) & (wk % 3 == 0), 4).otherwise(ln) * 250).cast("double")).alias("TD"),
            F.when((ln != 3) | (wk % 7 != 0), (10 + ln).cast("double")).alias("Netpay"),
        )

    @cached_property
    def productiondata(self):
        wk, ln, rate = F.col("s_suppkey"), F.col("l_linenumber"), F.col("l_quantity")
        year = F.year("l_shipdate")
        status = F.when((wk % 4 == 0) | ((wk % 4 == 1) & (year >= 1998)), 2).otherwise(1)

        def while_status(wanted, value):
            return F.when(status == wanted, value).otherwise(F.lit(0.0))

        unknown_gas = (ln == 5) & (F.col("l_returnflag") == "N")
        returned = F.col("l_returnflag") == "R"
        return self._with_case(self._read("lineitem"), "l_suppkey").select(
            F.col("r_name").alias("casename"),
            _well_name("s_suppkey").alias("WellAPI"),
            ln.cast("string").alias("CompSubId"),
            year.alias("Year"),
            F.when((rate == 47) & (ln == 2), 13).otherwise(F.month("l_shipdate")).alias("Month"),
            status.alias("Status"),
            F.when(~(returned & (rate == 50)), while_status(1, rate)).alias("Qo"),
            F.when(~(returned & (rate == 49)), while_status(1, rate * (ln % 3))).alias("Qw"),
            F.when(~unknown_gas, while_status(1, rate * 4)).alias("Qg"),
            F.when(~(returned & (rate == 48)), while_status(2, rate * 8)).alias("Qs"),
            (F.lit(1000.0) + rate).alias("BHP"),
        )

    def _steps(self, status, **rates):
        """Modelled rates: a measured month moved by MODEL_DELAY, scaled by completion and percentile."""
        rows = self.productiondata.filter((F.col("Status") == status) & (F.col("Month") <= 12))
        number = F.col("CompSubId").cast("int")
        sums = rows.groupBy("casename", "WellAPI", "CompSubId", "Year", "Month").agg(
            *[F.sum(value).alias(phase) for phase, (value, _) in rates.items()]
        )
        scale = F.lit(0.75) + F.lit(0.25) * (number % 3)
        scaled = {
            phase: F.col(phase) * scale if is_scaled else F.col(phase)
            for phase, (_, is_scaled) in rates.items()
        }
        return sums.select(
            "casename",
            F.col("WellAPI").alias("WellId"),
            number.alias("CompletionId"),
            F.add_months(month_date("Year", "Month"), MODEL_DELAY).alias("Date"),
            *[
                (value * factor).alias(f"{phase}RateP{p}")
                for phase, value in scaled.items()
                for p, factor in BAND_FACTORS.items()
            ],
        )

    @cached_property
    def producer_timestep(self):
        oil, gross = F.col("Qo"), F.col("Qo") + F.col("Qw")
        return self._steps(1, Oil=(oil, True), Gross=(gross, True), Gas=(F.col("Qg"), False))

    @cached_property
    def injector_timestep(self):
        return self._steps(2, Injectant=(F.col("Qs"), True))

    @cached_property
    def predictions(self):
        return self._predictions(F.col("o_orderpriority"))

    @cached_property
    def customer_predictions(self):
        """As `predictions`, with one fit per customer."""
        return self._predictions(F.concat(F.lit("CUST"), F.col("o_custkey").cast("string")))

    def _predictions(self, fit):
        """Every seventh manifest is cut short, every eleventh lists nothing."""
        number, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
        manifest = F.concat(
            F.lit('{"files":{"final":{"SensitivityMatrixCumWWell.csv":"blob/'), key,
            F.lit('.csv"},"intermediateOutput":{"fit_output.json":"blob/'), key, F.lit('.json"}}}'),
        )
        return self._read("orders").select(
            fit.alias("fit"),
            F.concat(F.lit("PRED"), key).alias("name"),
            number.alias("seq"),
            F.when(number % 7 == 0, F.lit('{"files":{"final":'))
            .when(number % 11 == 0, F.lit("{}"))
            .otherwise(manifest)
            .alias("manifest"),
        )

    @cached_property
    def artefacts(self):
        """The files behind the last prediction of each customer, as (path, content).

        Every fifth has no file, and the documents of every thirteenth are cut short.
        """
        orders = self._read("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("number"))
        number, key = F.col("number"), F.col("number").cast("string")
        document = F.concat(
            F.lit('{"loss": '), (number % 100 * 0.25).cast("string"),
            F.lit(', "wells": [{"name": "W1", "r2": 0.5}, {"name": "W'), key, F.lit('", "r2": null}]}'),
        )
        matrix = F.concat(F.lit('Well,W1,"W,2"\r\nW1,0.5,\r\n"W,2",'), key, F.lit(',"x ""y""\nz"\r\n'))
        files = F.array(
            F.struct(F.concat(F.lit("blob/"), key, F.lit(".json")).alias("path"), F.when(number % 13 == 0, F.substring(document, 1, 12)).otherwise(document).alias("content")),
            F.struct(F.concat(F.lit("blob/"), key, F.lit(".csv")).alias("path"), matrix.alias("content")),
        )
        return orders.filter(number % 5 != 0).select(F.explode(files).alias("f")).select("f.path", F.encode("f.content", "UTF-8").alias("content"))

    @cached_property
    def dated_texts(self):
        """Dates as a web service sends them, with a time behind."""
        text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
        return self._read("orders").select(F.col("o_orderkey").alias("key"), text.alias("text"))

    @cached_property
    def selected_points(self):
        """Wells with a completion inside a band of latitude, as drawn on a map."""
        inside = (F.col("Latitude") >= 5) & (F.col("Latitude") < 9)
        return self.completiondata.filter(inside).select("casename", "WellAPI").distinct()

    @cached_property
    def picked_values(self):
        """Chosen layers, blocks and compartments per case, as rows of (case, list, value).

        Cases with an even key choose layers, case 1 a layer that nobody has and case 2 blocks as well; case 3 chooses nothing.
        """
        key = F.col("r_regionkey")
        text = "array<struct<list:string,value:string>>"
        pairs = F.expr(
            "concat("
            f"if(r_regionkey % 2 = 0, array(('layers', 'RES_1'), ('layers', 'RES_3')), array()),"
            f"if(r_regionkey = 1, array(('layers', 'no such layer')), array()),"
            f"if(r_regionkey = 2, array(('faultblocks', 'FB_0'), ('faultblocks', 'FB_2'), ('compartments', CAST(NULL AS STRING))), array()))"
        ).cast(text)
        return self._read("region").filter(key != 3).select(F.col("r_name").alias("casename"), F.inline(pairs))
