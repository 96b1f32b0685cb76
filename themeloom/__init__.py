"""themeloom: text-topic analytics as DataFrame operators."""
