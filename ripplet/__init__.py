"""Program-dependency impact analytics and training-data operators on Spark."""
