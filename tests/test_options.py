"""Trip options: walks and waits between rides, and each reason to refuse one."""

from wayfold.operators import options

LAT, LON = 37.95, 58.3
JOURNEY = "id int, origin struct<stop_id: bigint, lat: double, lon: double>, target struct<stop_id: bigint, lat: double, lon: double>, rides array<struct<route_id: bigint, start: struct<stop_id: bigint, lat: double, lon: double>, stop: struct<stop_id: bigint, lat: double, lon: double>, ride_s: bigint, wait_s: bigint>>"


def place(stop, metres):
    return (stop, LAT + metres / 111_194.93, LON)


def ride(route, a, b, ride_s=600, wait_s=300):
    return (route, a, b, ride_s, wait_s)


HOME, A, B, NEAR_B, C, D, END = place(None, 0), place(1, 400), place(2, 5000), place(3, 5300), place(4, 9000), place(5, 14000), place(None, 14100)
CASES = {
    1: (HOME, END, [ride(7, A, D, 59)], "WALK::5;WAIT:7:5;RIDE:7:1;WALK::2", "OK"),
    2: (HOME, END, [ride(7, A, B), ride(8, NEAR_B, D, 725, 119)], "WALK::5;WAIT:7:5;RIDE:7:10;WALK::4;WAIT:8:1;RIDE:8:12;WALK::2", "OK"),
    3: (HOME, END, [ride(7, A, B), ride(8, B, C), ride(9, C, D)], "WALK::5;WAIT:7:5;RIDE:7:10;WAIT:8:5;RIDE:8:10;WAIT:9:5;RIDE:9:10;WALK::2", "OK"),
    4: (place(None, -900), END, [ride(7, A, D)], None, "WALK"),
    5: (HOME, place(None, 16000), [ride(7, A, D)], None, "WALK"),
    6: (HOME, END, [ride(7, A, B), ride(7, B, D)], None, "ROUTES"),
    7: (HOME, END, [ride(7, A, B), ride(8, B, D, 600, 31 * 60)], None, "WAIT"),
    8: (HOME, END, [ride(7, A, B), ride(8, B, D, 600, 30 * 60)], None, "OK"),
    9: (HOME, END, [ride(7, A, B), ride(8, B, C), ride(9, C, D, 600, 26 * 60)], None, "WAIT"),
    10: (HOME, END, [ride(7, A, B, 3000), ride(8, B, D, 2460)], None, "TOTAL"),
    11: (HOME, END, [ride(7, A, B, 3000), ride(8, B, D, 2400)], None, "OK"),
    12: (HOME, END, [ride(7, A, B, 4000), ride(8, B, C, 4000), ride(9, C, D, 600)], None, "TOTAL"),
    13: (HOME, END, [ride(7, A, B), ride(8, place(2, 5600), D)], None, "GAP"),  # one stop, two places
    14: (HOME, END, [ride(7, A, B), ride(8, B, C), ride(9, C, NEAR_B), ride(10, NEAR_B, D)], None, "TOTAL"),
    15: (HOME, END, [], None, "NO_RIDE"),
    16: (HOME, END, None, None, "NO_RIDE"),
    17: (HOME, END, [ride(7, A, D, None)], None, "UNKNOWN"),
    18: (HOME, END, [ride(7, A, D, 600, None)], None, "UNKNOWN"),
    19: (A, D, [ride(7, A, D)], "WAIT:7:5;RIDE:7:10", "OK"),
}


def test_legs_and_verdicts(spark):
    df = spark.createDataFrame([(k, o, t, r) for k, (o, t, r, *_) in CASES.items()], JOURNEY)
    rows = {r["id"]: r for r in options.assemble(df).withColumn("path", options.path(options.F.col("legs"))).collect()}
    assert {k: rows[k]["verdict"] for k in CASES} == {k: c[4] for k, c in CASES.items()}
    assert {k: rows[k]["path"] for k, c in CASES.items() if c[3]} == {k: c[3] for k, c in CASES.items() if c[3]}
    two = rows[2]
    assert (two["walk_min"], two["wait_min"], two["ride_min"], two["minutes"], two["transfers"]) == (11, 6, 22, 39, 1)
    assert options.assemble(df.limit(0)).isEmpty()
