"""The engine answers questions about stored networks; it defines no streaming operators."""
