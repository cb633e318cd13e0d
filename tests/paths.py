"""Where the supplied tables are."""

SF0001 = "/root/testdata/sf0.001"
