"""Packets for the tests, and the folder of the smallest tables."""

SF = "/root/testdata/sf0.001"

# One sample packet exactly as a device prints it.
SAMPLE = (
    "CSI_DATA,0,94:d9:b3:80:8c:81,-30,11,1,6,1,0,1,0,1,0,0,-93,0,13,2,2751923,0,67,0,128,1,"
    '"[67,48,4,0,0,0,0,0,0,0,5,0,20,1,20,1,19,0,17,1,16,2,15,2,14,1,12,0,12,-1,12,-3,12,-4,13,-6,15,-7,16,-8,16,-8,'
    "16,-8,16,-6,15,-5,15,-4,14,-4,13,-4,12,-4,11,-4,10,-4,9,-5,8,-6,4,-4,8,-9,9,-10,9,-10,10,-11,11,-10,11,-10,12,-9,"
    "11,-8,11,-7,10,-6,9,-6,7,-6,6,-7,5,-7,5,-8,5,-9,5,-10,5,-11,5,-11,6,-11,7,-11,8,-11,9,-10,9,-9,8,-8,8,-7,1,-2,"
    '0,0,0,0,0,0,0,0]"'
)


def line(seq=0, **fields):
    """A packet line; fields are texts by wire name, ``data`` with its quotes."""
    parts = SAMPLE.split(",", 24)
    from csilake.schema import WIRE_NAMES

    values = dict(zip(WIRE_NAMES, parts))
    values["seq"] = str(seq)
    values.update(fields)
    return ",".join(values[name] for name in WIRE_NAMES)


def frame(spark, lines):
    return spark.createDataFrame([(i, text) for i, text in enumerate(lines)], "nr int, value string")
