from yardstream.operators import trips as T


def test_open_trips_meet_on_the_lookup_key(spark):
    rows = [(1, "MH12AB1234", "arrived"), (2, "mh 12-AB 1234", "scheduled"), (3, "MH12AB1234", "completed"), (4, None, "arrived"), (5, "", "arrived"), (6, " KA01C0001", "cancelled")]
    trips = spark.createDataFrame([(i, f"T{i}", p, s, "delivery", "G1") for i, p, s in rows], "trip_id long, trip_number string, plate_number string, status string, purpose string, gate_name string")
    assert [(r.plate_number, r.trip_id) for r in T.open_trip_per_plate(trips).collect()] == [("MH12AB1234", 2)]
