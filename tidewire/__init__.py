"""Signal, packet, log and payload analytics expressed as Spark DataFrame operators."""
