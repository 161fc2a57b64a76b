"""Where the tests find their tables."""

SF_DIR = "/root/testdata/sf0.001"
