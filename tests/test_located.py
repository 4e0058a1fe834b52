"""Where a record is: by its columns, else by what its document states."""

from factloom.operators import facts

BOX = (-75.80, 38.44, -74.98, 39.85)


def test_cascade(spark):
    records = spark.createDataFrame([(1, "38.7", "-75.3", None), (2, None, None, None), (3, None, None, None), (4, "10.0", "-75.3", None), (5, None, None, "(38.9, -75.5)"), (6, None, None, None)], "subject long, lat string, lon string, geo string")
    pages = spark.createDataFrame(
        [(1, 1, "Latitude: 39.111 Longitude: -75.111"), (2, 1, "LATITUDE 38,500\nlongitude:-75,400"), (2, 3, "latitude 38.612 latitude 38.613"), (2, 2, "Latitude: 39.999"), (3, 1, "Latitude: 38.512"), (3, 2, "Longitude: -75.1"), (4, 1, "Latitude 38.6001 Longitude -75.6001"), (6, 1, "Latitude 44.6001 Longitude -75.6001"), (7, 9, "Latitude 38.7001 Longitude -75.7001"), (8, 1, None)],
        "subject long, page int, txt string",
    )
    got = {r.subject: (r.lat, r.lon, r.origin, r.error) for r in facts.located(records, pages, BOX).collect()}
    assert got == {1: (38.7, -75.3, "record", None), 2: (38.613, -75.4, "document", None), 3: (None, None, None, "no location"), 4: (38.6001, -75.6001, "document", None), 5: (38.9, -75.5, "record", None), 6: (None, None, None, "no location"), 7: (38.7001, -75.7001, "document", None)}
    assert facts.located(records.limit(0), pages.limit(0), BOX).count() == 0
