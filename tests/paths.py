"""Where the driver's tables are."""

TESTDATA = "/root/testdata/sf0.001"
