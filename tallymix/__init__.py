"""tallymix: how a category mix is spread over time, groups and places, on Spark."""
