"""DataFrame operators for analysing the global IPv4 and IPv6 BGP routing table on Spark."""
