"""DataFrame operators: tables in, tables out, nothing collected to the driver."""
