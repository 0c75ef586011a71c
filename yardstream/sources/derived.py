"""Gate tables derived from the star-schema test tables.

Every function maps driver tables to one domain table with narrow projections
and equi-joins; the same definitions in SQL are in ``bindings/views.py``.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: two-letter codes by nation number
_CODES = "ANAPARASBRCGCHDDDLDNGAGJHPHRJHJKKAKLLALDMHMLMNMPMZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as vehicle_id",
        f"""concat(substr('{_CODES}', cast(c_nationkey*2+1 as int), 2),
                   lpad(cast(c_custkey%97+1 as string), 2, '0'),
                   chr(cast(65+c_custkey%26 as int)),
                   chr(cast(65+cast(floor(c_custkey/26) as bigint)%26 as int)),
                   lpad(cast((c_custkey*7919)%10000 as string), 4, '0')) as plate_number""",
        """case c_custkey%4 when 0 then 'Truck' when 1 then 'Car' when 2 then 'Bus'
           else 'Two wheeler' end as vehicle_type""",
        "c_name as owner_name",
        "c_mktsegment as transporter",
        "c_custkey%17 <> 0 as is_authorized",
        "c_custkey%3 = 0 as whitelisted",
        "c_custkey%29 = 0 as watchlisted",
    )


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vehicles(spark, sf_dir).filter("whitelisted").select(
        "vehicle_id", "plate_number", F.lit("Fleet registration").alias("reason"), F.lit(True).alias("is_active")
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vehicles(spark, sf_dir).filter("watchlisted").select(
        "vehicle_id", "plate_number", F.lit("Security watchlist").alias("reason"), F.lit(True).alias("is_active")
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "n_nationkey as camera_id",
        """concat('C', lpad(cast(n_nationkey as string),2,'0'),
                  case when n_nationkey%3=0 then '-EXIT' else '-ENTRY' end) as camera_code""",
        "n_name as camera_name",
        "r_regionkey as gate_id",
        "concat('Gate 0', cast(r_regionkey+1 as string)) as gate_name",
        "concat('G0', cast(r_regionkey+1 as string)) as gate_code",
        "case when n_nationkey%3=0 then 'exit' when n_nationkey%7=0 then 'both' else 'entry' end as direction",
        "case when n_nationkey%11=0 then 'offline' else 'online' end as status",
    )


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "r_regionkey as gate_id",
        "concat('Gate 0', cast(r_regionkey+1 as string)) as gate_name",
        "concat('G0', cast(r_regionkey+1 as string)) as gate_code",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events"), vehicles(spark, sf_dir)
    return e.join(v, F.col("user_id") == F.col("vehicle_id")).selectExpr(
        "event_id as read_id",
        "ts",
        "cast(event_id%25 as int) as camera_id",
        "user_id as vehicle_id_true",
        """case when event_id%97=0 then ''
                when event_id%10=0 then concat('ZZ99XX', lpad(cast(user_id as string),4,'0'))
                when event_id%4=1 then lower(concat(substr(plate_number,1,4),' ',substr(plate_number,5,2),'-',
                                                    substr(plate_number,7,4)))
                else plate_number end as raw_plate""",
        "cast(55 + (event_id*37)%45 as double)/100 as confidence",
        "event_id%23=0 as is_corrected",
        "event_type as tag",
        "value",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as the nested JSON messages a camera service sends; absent fields are left out."""
    r = reads(spark, sf_dir).join(cameras(spark, sf_dir), "camera_id")
    frame = """named_struct('frame_number', cast(read_id%50+{k} as int),
        'plate', if(read_id%2=0, raw_plate, null), 'text', if(read_id%2=0, null, lower(raw_plate)),
        'confidence', confidence)"""
    body = r.selectExpr(
        "read_id",
        "ts",
        "raw_plate as plate_number",
        "if(read_id%5=0, null, 'finalized') as status",
        "read_id%400 as track_id",
        "if(read_id%13=0, null, if(read_id%6=0, confidence*100, confidence)) as final_confidence",
        "if(read_id%3=0, null, if(read_id%3=1, 'TRUCK', 'bus')) as vehicle_type",
        "if(read_id%19=0, null, camera_code) as camera_id",
        "if(read_id%17=0, null, if(read_id%7=0, gate_code, gate_name)) as gate_id",
        "is_corrected",
        "cast(read_id%4 as int) as frame_count",
        """if(read_id%8=0, null, array(cast(read_id%640 as double), cast(read_id%360 as double),
              cast(read_id%640+80 as double), cast(read_id%360+60 as double))) as vehicle_bbox""",
        f"""case read_id%3 when 0 then cast(array() as array<struct<frame_number:int,plate:string,text:string,confidence:double>>)
             when 1 then array({frame.format(k=1)}) else array({frame.format(k=1)}, {frame.format(k=3)}) end
             as frame_predictions""",
    )
    fields = [c for c in body.columns if c not in ("read_id", "ts")]
    return body.select("read_id", "ts", F.to_json(F.struct(*fields)).alias("payload"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, v = table(spark, sf_dir, "orders"), vehicles(spark, sf_dir)
    return o.join(v, F.col("o_custkey") == F.col("vehicle_id")).selectExpr(
        "o_orderkey as trip_id",
        "concat('TRIP-', cast(o_orderkey as string)) as trip_number",
        "o_custkey as vehicle_id",
        "plate_number",
        "transporter",
        "concat('Gate 0', cast(o_orderkey%5+1 as string)) as gate_name",
        "o_orderpriority as purpose",
        "o_orderdate as expected_arrival",
        "o_orderdate + (o_orderkey%6+1) * interval '1' hour as expected_departure",
        """case when o_orderstatus <> 'P' then o_orderdate + (o_orderkey%90) * interval '1' minute end
           as actual_entry_time""",
        """case when o_orderstatus = 'F' then o_orderdate + (o_orderkey%90 + (o_orderkey*13)%240+1)
           * interval '1' minute end as actual_exit_time""",
        "case when o_orderstatus = 'F' then cast((o_orderkey*13)%240+1 as int) end as dwell_minutes",
        """case o_orderstatus when 'F' then 'completed' when 'P' then 'scheduled' else
             case o_orderkey%4 when 0 then 'arrived' when 1 then 'entry_approved'
                               when 2 then 'inside_plant' else 'at_destination' end end as status""",
    )


def trip_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trips(spark, sf_dir)
    steps = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("scheduled").alias("to_status"), F.col("expected_arrival").alias("ts")),
        F.struct(F.lit(2).alias("seq"), F.lit("inside_plant").alias("to_status"), F.col("actual_entry_time").alias("ts")),
        F.struct(F.lit(3).alias("seq"), F.lit("completed").alias("to_status"), F.col("actual_exit_time").alias("ts")),
    )
    return t.select("trip_id", F.inline(steps)).filter("seq = 1 or ts is not null")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, v = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), vehicles(spark, sf_dir)
    # Orders get their plate and lineitems that of another vehicle first: so the lineitems are shuffled twice, the
    # last time by the order that numbers their frames.
    plate = o.join(v, F.col("o_custkey") == F.col("vehicle_id")).select("o_orderkey", F.col("plate_number").alias("v_plate"))
    other = v.select(F.col("vehicle_id").alias("w_id"), F.col("plate_number").alias("other_plate"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        li.join(other, F.col("l_suppkey") == F.col("w_id"))
        .withColumn("w_plate", F.expr("case when l_partkey%11=0 then other_plate end")).drop("w_id", "other_plate")
        .join(plate, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("frame_number", F.row_number().over(order))
        .selectExpr(
            "l_orderkey as track_id",
            "frame_number",
            "v_plate as true_plate",
            "case when l_returnflag='N' then 'Night' else 'Day' end as condition",
            """case when l_partkey%11=0 then w_plate
                    when l_partkey%4=0 then concat(substr(v_plate,1,6), translate(substr(v_plate,7,4),'0158','OISB'))
                    when l_partkey%9=0 then concat('IND', v_plate) else v_plate end as raw_text""",
            "round(0.5 + l_discount*4, 2) as ocr_confidence",
            "round(0.6 + l_tax*4, 2) as plate_confidence",
            """case cast(l_quantity as int)%4 when 0 then 'truck' when 1 then 'car' when 2 then 'bus'
               else 'motorcycle' end as vehicle_class""",
            "cast(l_partkey%1000 as double) as x1",
            "cast(l_suppkey%500 as double) as y1",
            "cast(l_partkey%1000 as double)+50+l_quantity*4 as x2",
            "cast(l_suppkey%500 as double)+40+l_quantity*3 as y2",
        )
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("frame_id").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("frame_id", F.expr("cast(floor(l_orderkey/10) as bigint)"))
        .withColumn("box_id", F.row_number().over(order))
        .selectExpr(
            "frame_id",
            "box_id",
            "cast((l_partkey*31)%640 as double) as x1",
            "cast((l_suppkey*17+l_partkey)%360 as double) as y1",
            "cast((l_partkey*31)%640 as double)+60+l_quantity*2 as x2",
            "cast((l_suppkey*17+l_partkey)%360 as double)+50+l_quantity as y2",
            "round(0.3 + l_discount*5, 2) as confidence",
        )
    )


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey*100+l_linenumber as crop_id",
        "cast(10+l_quantity*4 as int) as w",
        "cast(4+(l_partkey%40) as int) as h",
        "cast(l_partkey%260 as double) as brightness",
        "l_discount*200 as contrast",
        "l_quantity/2 as sharpness",
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as driver_id",
        "s_name as name",
        "concat('LIC-', lpad(cast(s_suppkey as string),6,'0')) as license_number",
        "s_suppkey as assigned_vehicle_id",
        "s_suppkey%13<>0 as is_active",
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as sample_id",
        "cast(event_id%25 as int) as camera_id",
        "event_type <> 'error' as is_online",
        "ts as last_check_at",
        "value as response_time_ms",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr(
        "event_id as alert_id",
        """case event_id%3 when 0 then 'Watchlist Alert' when 1 then 'Unknown Vehicle'
           else 'Low Confidence Read' end as alert_type""",
        "case event_id%3 when 2 then 'medium' else 'high' end as severity",
        "cast(event_id%25%5+1 as bigint) as gate_id",
        "ts as created_at",
        "event_id%4=0 as is_read",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader texts of many shapes: prefixes, border marks, short and long plates, confusions."""
    e, v = table(spark, sf_dir, "events"), vehicles(spark, sf_dir)
    return (
        e.join(v, F.col("user_id") == F.col("vehicle_id"))
        .withColumnRenamed("plate_number", "p")
        .selectExpr(
            "event_id as read_id",
            "ts",
            """case event_id%16 when 0 then lower(concat(substr(p,1,4),' ',substr(p,5,6))) when 1 then concat('IND', p)
               when 2 then concat('IN', p) when 3 then concat('1', p) when 4 then concat('E', p) when 5 then concat('XX', p)
               when 6 then concat(p, '1') when 7 then concat(p, 'I') when 8 then concat(substr(p,1,5), substr(p,7,4))
               when 9 then concat(substr(p,1,4), substr(p,7,4)) when 10 then concat('0L', substr(p,3,8))
               when 11 then concat(substr(p,7,2), 'BH', substr(p,7,4), substr(p,5,1))
               when 12 then concat(substr(p,1,4), 'ABC', substr(p,7,4)) when 13 then translate(p, '0158', 'OISB')
               when 14 then concat(substr(p,1,4), '-T', substr(p,5,6)) else substr(p, 1, cast(event_id%9 as int)) end as text""",
            "cast(55 + (event_id*37)%45 as double)/100 as confidence",
            "user_id",
        )
    )
