"""The small tables that tests of registered queries read."""
SF = "/root/testdata/sf0.001"
