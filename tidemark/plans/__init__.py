"""Views of the driver's tables as versioned data, logs, transactions and traces."""
